import collections
import random

import numpy as np

from rillstone.llm import chat, common, compiled, decontamination, embedding_dedup, language_id, line_dedup, near_dedup, queries


def test_embeddings_of_a_large_near_group(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 64))
    x[:2000] = x[0] + rng.normal(size=(2000, 64)) * 0.1
    x = x[rng.permutation(len(x))]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.link_embeddings(rows).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= close.sum(axis=1)).all() and found.sum() >= 0.97 * close.sum()
    assert sum(r["kept"] for r in got.values()) == 4001


def test_spread_points():
    rng = np.random.default_rng(1)
    u = rng.normal(size=(400, 8))
    u[:300] = u[0] + rng.normal(size=(300, 8)) * 0.01
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    at = embedding_dedup.spread(u, 90, 18, 0.95)
    assert len(set(at.tolist())) == len(at) == 90 and (at < 300).sum() == 1
    assert len(embedding_dedup.spread(u[:300], 90, 18, 0.95)) == 18
    assert len(embedding_dedup.spread(u[:5], 90, 18, 0.95)) == 5 and len(embedding_dedup.spread(u[:0], 90, 18, 0.95)) == 0


def test_near_duplicates_at_the_threshold(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts = []
    for size in (5, 10, 20, 45, 60, 120, 240):
        for similarity in (0.8, 0.85, 0.9):
            for _ in range(25):
                a = [word() for _ in range(size)]
                b = list(a)
                for k in rng.sample(range(size), int((1 - similarity) * size + 1e-9)):
                    b[k] = word()
                assert common.banded_distance(a, b, size) <= 0.2 * size + 1e-9
                texts += [" ".join(a), " ".join(b)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(rows).collect()}
    met = [got[i] == got[i + 1] == i for i in range(0, len(texts), 2)]
    assert sum(met) >= 0.98 * len(met)
    assert all(got[i] in (i, i - i % 2) for i in got)


def test_near_duplicates_of_short_texts(spark):
    texts = ["ka lo mi na", "ka lo mi na pu", "ka lo xx na pu", "ka lo mi", "ka lo mi zu", "qu ro si", "ro qu si tu"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(rows).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6}


def test_lines_within_a_share_by_brute_force(spark, tmp_path):
    rng = random.Random(9)
    char = lambda: rng.choice("abcdefghijklmnopqrst ")
    lines = []
    for size in (20, 25, 39, 40, 59, 60, 61, 80, 130, 200, 400, 1400):
        for _ in range(15):
            a = "x" + "".join(char() for _ in range(size - 2)) + "y"
            places = sorted(rng.sample(range(1, size - 1), size // 20), reverse=True)
            b = list(a)
            for k in places:
                b[k : k + 1] = rng.choice([[], [char(), b[k]], ["Z"]])
            at = rng.randrange(size - size // 20)
            lines += [a, "".join(b), a[:at] + "Q" * (size // 20) + a[at + size // 20 :], a[: size // 2] + "W" * (size // 10 + 1) + a[size // 2 :]]
    count = collections.Counter(lines)
    want = 0
    for x in count:
        for y in count:
            most = max(len(x), len(y)) // 20
            if x != y and abs(len(x) - len(y)) <= most and common.banded_distance(x, y, most) <= most:
                want += count[x] * count[y]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op9_line_dedup(spark, str(tmp_path)).selectExpr("sum(n_links)", "count(*)").first()
    assert found[1] == len(lines) and want > 700
    links = found[0] - sum(n * (n - 1) for n in count.values())
    assert 0.99 * want <= links <= want


def test_sketch_keys_meet():
    rng = random.Random(2)
    met = []
    for size in (60, 100, 200, 800):
        for _ in range(250):
            a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(size))
            b = list(a)
            for k in sorted(rng.sample(range(size), size // 20), reverse=True):
                b[k : k + 1] = rng.choice([[], ["#", b[k]], ["#"]])
            row, keys = line_dedup.sketch_keys([a, "".join(b)][:: rng.choice([1, -1])], 0.05)
            met.append(bool(set(keys[row == 0].tolist()) & set(keys[row == 1].tolist())))
    assert sum(met) >= 0.985 * len(met), sum(met)


def test_near_duplicates_of_repeated_ids(spark):
    rows = [(5, "ka lo mi na pu qu"), (5, "zu wo xi ya te si"), (6, "ka lo mi na pu qu"), (7, "zu wo xi ya te si"), (None, "ka lo mi na pu qu"), (8, "ka lo mi na pu qu"), (8, "ka lo mi na pu qu")]
    got = sorted(((r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    same = [(5, 5), (5, 5), (6, 5), (7, 7), (8, 5), (8, 5), (None, None)]
    other = [(5, 5), (5, 5), (6, 6), (7, 5), (8, 6), (8, 6), (None, None)]
    assert got in (sorted(same, key=str), sorted(other, key=str))


def test_near_duplicates_by_brute_force(spark):
    """All pairs of a few hundred documents: no class joins what no links join, and nearly all links are within one."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 6))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 45, 90, 200]))) for _ in range(60)]
    for t in list(texts):
        for share in (0.05, 0.1, 0.18):
            words = t.split()
            for k in rng.sample(range(len(words)), int(share * len(words))):
                words[k] = rng.choice(vocabulary)
            if rng.random() < 0.5:
                words.insert(rng.randrange(len(words)), "zzz")
            texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(rows).collect()}
    split = [t.split() for t in texts]
    root, links = list(range(len(texts))), []
    for i in range(len(texts)):
        for j in range(i):
            most = int(0.2 * max(len(split[i]), len(split[j])) + 1e-9)
            if common.banded_distance(split[i], split[j], most) <= most:
                links.append((i, j))
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert all(root[i] == root[got[i]] for i in got)
    assert len(links) > 200 and sum(got[i] == got[j] for i, j in links) >= 0.98 * len(links)


def _alike(window, item, width=5):
    a, b = (collections.Counter(tuple(x[i : i + width]) for i in range(len(x) - width + 1)) for x in (window, item))
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_contaminated_by_brute_force(spark):
    """All windows of all documents, among them passages with swapped halves, repeated runs and changed words."""
    rng = random.Random(5)
    word = lambda: rng.choice("ka lo mi na pu qu ro si te vu wo xa yi ze".split()) + rng.choice("ab cd ef gh".split())
    items = [[word() for _ in range(n)] for n in (5, 12, 30, 30, 80, 80)]
    items.append(items[2][:10] * 4)
    documents = []
    for item in items:
        for kind in range(9):
            passage = list(item)
            if kind in (1, 2):
                passage = passage[len(item) // 2 :] + passage[: len(item) // 2]
            for _ in range((0, 0, 0, 1, 2, 1, 3, 0, 0)[kind]):
                passage[rng.randrange(len(passage))] = word()
            if kind == 7:
                del passage[len(passage) // 2]
            if kind == 8:
                passage = passage + passage
            side = 0 if kind == 1 else 50
            documents.append([word() for _ in range(side)] + passage + [word() for _ in range(side)])
    want = {}
    for d, doc in enumerate(documents):
        for i, item in enumerate(items):
            n = min(len(item), len(doc))
            best = max(_alike(doc[s : s + n], item) for s in range(len(doc) - n + 1))
            if best >= 0.8:
                want[d, i] = round(best, 9)
    bench = spark.createDataFrame([(i, " ".join(x), "c", 1, [1]) for i, x in enumerate(items)], "item_id long, text string, check string, n long, windows array<int>")
    rows = spark.createDataFrame([(i, " ".join(x), "c", 1, 2, [1]) for i, x in enumerate(documents)], "doc_id long, text string, check string, n long, start long, windows array<int>")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontamination.contaminated(rows, bench).collect()}
    assert got == want and len(want) > 25
    left = decontamination.drop_contaminated(rows, decontamination.contaminated(rows, bench))
    assert {r["doc_id"] for r in left.collect()} == set(range(len(documents))) - {d for d, _ in want}


def test_hamming_blocks_meet_within_the_radius(spark):
    rng = random.Random(6)
    pairs = []
    for distance in range(decontamination.RADIUS + 1):
        for _ in range(20):
            a = rng.getrandbits(64)
            b = a
            for k in rng.sample(range(64), distance):
                b ^= 1 << k
            pairs.append([x - (1 << 64) if x >> 63 else x for x in (a, b)])
    rows = spark.createDataFrame(pairs, "a long, b long").select(decontamination.hamming_blocks("a").alias("a"), decontamination.hamming_blocks("b").alias("b"))
    assert rows.where("arrays_overlap(a, b)").count() == len(pairs)


def test_escapes_leave_no_control_string():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice(["<", "|", ">", "\\", "s", "/", "[INST]", "<|>", "</s>", "<<SYS>>", "a", "\n"]) for _ in range(rng.randrange(8)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROL)


def test_letters_are_those_of_python():
    _, is_letter = language_id.letters()
    assert is_letter.tolist() == [chr(c).isalpha() for c in range(0x110000)]


def test_pipeline_stages_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    text = "the same few words stand in this text and in its copies, which is why one of them stays"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, "another text that has no id but words of its own"), (3, None), (3, ""), (4, "unlike all others here, but its id stands twice"), (4, "other words under the id which stands twice as well")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "words that stand nowhere else at all in any row")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = corpus_pipeline.near(spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    left = sorted((str(r["doc_id"]), r["text"] or "") for r in near.collect())
    assert left == sorted([("2", text), ("None", rows[4][1]), ("3", ""), ("3", ""), ("4", rows[7][1]), ("4", rows[8][1])])
    assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).count() == len(rows)
    lines = sorted((str(r["doc_id"]), r["text"] or "") for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect())
    assert lines == sorted([("None", text), ("None", rows[4][1]), ("3", ""), ("3", ""), ("4", rows[7][1]), ("4", rows[8][1])])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_dropped_lines_stand_elsewhere(spark):
    docs = spark.createDataFrame([(1, "abc\nunique q"), (1, "r\nabc"), (2, "abc"), (5, "xyz"), (5, "xyz"), (6, " " * 50 + "\nw"), (7, " " * 51 + "\nw")], "doc_id long, text string")
    left = line_dedup.drop_lines(docs, share=line_dedup.SHARE)
    lines = sorted(x for r in left.collect() for x in r["text"].split("\n") if x.strip())
    assert lines == sorted(["abc", "unique q", "r", "xyz", "w"])


def _edited(rng, size):
    """A line, and one with as many edits as its length allows, as far apart from each other as they go, or nearly."""
    a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(size))
    b, n = list(a), size // 20
    for k in range(n, 0, -1):
        at = min(size - 1, max(0, k * size // (n + 1) + rng.randrange(-1, 2)))
        b[at : at + 1] = rng.choice(["#", "", b[at] + "#"])
    return a, "".join(b)


def test_chosen_grams_of_linked_lines_always_meet():
    rng = random.Random(12)
    pairs = [_edited(rng, size) for size in (60, 61, 79, 80, 99, 100, 119, 140, 199, 200, 399, 400, 1200, 3000) for _ in range(60)]
    # copies of one run of characters, whose grams are all equal
    pairs += [("ab" * 50, "ab" * 30 + "c" + "ab" * 19 + "x"), ("a" * 60, "a" * 57)]
    lines = [x for pair in pairs for x in pair]
    row, keys = line_dedup.sketch_keys(lines, 0.05)
    own = [set(part.tolist()) for part in np.split(keys[np.argsort(row, kind="stable")], np.cumsum(np.bincount(row, minlength=len(lines)))[:-1])]
    for k, (a, b) in enumerate(pairs):
        assert common.banded_distance(a, b, 200) <= max(len(a), len(b)) // 20 and own[2 * k] & own[2 * k + 1], (k, len(a))


def test_no_link_of_lines_is_lost(spark, monkeypatch):
    """Edits far apart, groups of near copies, and keys that so many lines have that they meet in their own task."""
    rng = random.Random(13)
    lines = [x for size in (59, 60, 80, 100, 140, 200, 300) for _ in range(12) for x in _edited(rng, size)]
    stem, head = _edited(rng, 120)[0], "".join(rng.choice("abcdefghij") for _ in range(60))
    for _ in range(40):
        at = rng.randrange(110)
        lines.append(stem[:at] + "".join(rng.choice("uvwxyz") for _ in range(3)) + stem[at + 3 :])
        lines.append(head + "".join(rng.choice("klmnopqrst") for _ in range(60)))
    want = {x: 0 for x in lines}
    for x in want:
        for y in want:
            most = max(len(x), len(y)) // 20
            want[x] += x != y and abs(len(x) - len(y)) <= most and common.banded_distance(x, y, most) <= most
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3).cache()
    assert len(want) == len(lines) and sum(want.values()) > 700
    for hot in (line_dedup.HOT, 3):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        got = {r["doc_id"]: r["n_links"] for r in line_dedup.line_classes(rows, share=line_dedup.SHARE).collect()}
        assert [got[i] for i in range(len(lines))] == [want[x] for x in lines]


def test_workers_drop_other_operators_caches():
    assert queries.packing.encoder(queries.TOKENIZER) and language_id.letters()
    common.lighten(language_id.__name__)
    assert not queries.packing.encoder.cache_info().currsize and language_id.letters.cache_info().currsize


def test_lines_that_meet_by_chance_hardly_meet():
    """Of lines made of a few syllables, rare grams are chosen, and a gram brings lines together that is firm in one."""
    rng = random.Random(14)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    lines = ["".join(rng.choice(syllables[: rng.randrange(4, 21)]) + rng.choice(["", "", " "]) for _ in range(130)) for _ in range(3000)]
    points, sizes = common.code_points(lines)
    stretches, starts = common.Stretches(points), np.cumsum(sizes) - sizes
    count = np.zeros(1 << line_dedup.LEVEL_BITS, np.int64)
    np.add.at(count, (stretches.all(line_dedup.gram_size(0.05)) >> np.uint64(64 - line_dedup.LEVEL_BITS)).view(np.int64), 1)
    levels = np.minimum(np.ceil(np.log2(count + 1)), 15).astype(np.uint8)
    met = []
    for order in (None, levels):
        row, key, code = line_dedup._sketch_keys(stretches, starts, sizes, np.ones(len(lines), bool), 0.05, 2, order)
        met.append(len(line_dedup._parts(key >> np.uint64(16), row.astype(np.uint64), code if order is not None else code | np.uint16(1), 0.05)[0]))
    assert met[1] < 0.6 * met[0], met


def test_linked_lines_meet_by_a_firm_gram_whatever_the_levels():
    rng = random.Random(15)
    pairs = [_edited(rng, size) for size in (60, 79, 100, 141, 143, 200, 356, 400, 1200) for _ in range(40)]
    pairs += [("ab" * 50, "ab" * 30 + "c" + "ab" * 19 + "x"), ("a" * 60, "a" * 57)]
    points, sizes = common.code_points([x for pair in pairs for x in pair])
    for seed in range(2):
        levels = np.random.default_rng(seed).integers(0, 16 if seed else 1, 1 << line_dedup.LEVEL_BITS).astype(np.uint8)
        row, key, code = line_dedup._sketch_keys(common.Stretches(points), np.cumsum(sizes) - sizes, sizes, np.ones(len(sizes), bool), 0.05, 2, levels)
        group, short = line_dedup._parts(key >> np.uint64(16), row.astype(np.uint64), code, 0.05)
        together = {(int(a) // 2) for g in np.split(short, np.flatnonzero(np.diff(group)) + 1) for a in g if int(a) % 2 == 0 and int(a) + 1 in g}
        assert together == set(range(len(pairs)))


def test_java_loops_judge_pairs_as_python_does(spark):
    rng = random.Random(16)
    linked = compiled._classes(spark).loadClass("rillstone.Loops")
    loops = spark._jvm.java.lang.reflect.Array  # static methods are called by reflection, as the class isn't on the driver's class path
    strings = [linked.getMethods()[i] for i in range(loops.getLength(linked.getMethods())) if linked.getMethods()[i].getName() == "linked"][0]
    seen = set()
    for _ in range(400):
        letters = rng.choice(["ab", "abcdé", "abcdefgh \U0001f600ü漢"])
        a = [rng.choice(letters) for _ in range(rng.randrange(60))]
        b = list(a)
        for _ in range(rng.randrange(9)):
            if b:
                k = rng.randrange(len(b))
                b[k : k + 1] = rng.choice([[], [rng.choice(letters)], [b[k], rng.choice(letters)]])
        most = rng.randrange(8)
        given = spark.sparkContext._gateway.new_array(spark._jvm.Object, 3)
        given[0], given[1], given[2] = "".join(a), "".join(b), most
        want = common.banded_distance("".join(a), "".join(b), most) <= most
        assert strings.invoke(None, given) == want, (a, b, most)
        seen.add(want)
    assert seen == {True, False}


def test_java_loops_choose_grams_that_edits_leave(spark):
    """The grams of each line that the JVM chooses are those of the least ranks, hashed as numpy hashes them; edits can't
    reach all of them, and they are fewer than numpy's choice."""
    rng = random.Random(17)
    lines = [x for size in (60, 100, 142, 143, 151, 200, 400, 3000) for x in _edited(rng, size)] + ["é\U0001f600" * 60 + "漢z" * 30, "ab" * 50]
    share, low, middle = 0.05, *line_dedup._classes_of(0.05, 2)
    levels = np.random.default_rng(1).integers(0, 4, 1 << line_dedup.LEVEL_BITS).astype(np.uint8)
    row = compiled.first(spark.createDataFrame([(bytearray(levels.tobytes()),)], "levels binary"))
    udf = compiled.made(spark, "Chosen", spark.sparkContext._jsc.broadcast(row), line_dedup.LEVEL_BITS, share, low, middle, 10, 12)
    df = spark.createDataFrame([("\n".join(lines),), (None,)], "text string")
    got = compiled.called(df, udf, "text", "grams").collect()
    assert sorted(len(r["grams"]) for r in got)[0] == 0
    found = np.frombuffer(max((bytes(r["grams"]) for r in got), key=len), np.dtype([("hash", "<u8"), ("line", "<u4"), ("place", "<u4")]))
    points, sizes = common.code_points(lines)
    stretches, starts = common.Stretches(points), np.cumsum(sizes) - sizes
    ours = len(line_dedup._sketch_keys(stretches, starts, sizes, np.ones(len(sizes), bool), share, 2, levels)[0])
    assert 0 < len(found) < ours
    for k, size in enumerate(sizes.tolist()):
        for larger, gram in ((0, 10), (1, 12)):
            own = found[found["line"] == (k << 1 | larger)]
            assert (len(own) > 0) == (size >= middle if larger else size - size // 20 < middle)
            if not len(own):
                continue
            place = (own["place"] >> 1).astype(np.int64)
            every = stretches.all(gram)[starts[k] : starts[k] + size - gram + 1]
            assert (every[place] == own["hash"]).all()
            rank = levels[every >> np.uint64(64 - line_dedup.LEVEL_BITS)].astype(np.uint64) << np.uint64(36) | every >> np.uint64(28)
            assert set(np.flatnonzero(rank <= rank[place].max()).tolist()) == set(place.tolist())
            firm = place[own["place"] & 1 == 1]
            need = int(line_dedup.most_with(size, share)) + 1
            assert (np.diff(firm) >= gram).all() and (len(firm) == need or len(place) == len(every))
