import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rillstone.llm import chat, common, decontamination, embedding_dedup, language_id, line_dedup, near_dedup, packing, quality, queries, substring_dedup, token_counts

DATA = "/root/testdata/sf0.001"
TOKENIZER = queries.TOKENIZER
LIBRARY = Tokenizer.from_file(TOKENIZER)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, class_id string, line string, id string, weight string, n string"


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", None, "x", "x", "x", "x", "x") for i, t in texts], DOCS)


def small(spark, name="documents"):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "a"), (4, "a"), (None, "b c d e f g"), (5, "wörd " * 3000), (6, "x" * 20000), (7, "<|endoftext|> hi  there\n\n x<|endoftext|>")]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_counts_and_ids_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert token_counts.merger(TOKENIZER).count(text) == len(ids)
    assert packing.encoder(TOKENIZER).encode(text) == np.array(ids, "<u4").tobytes()


def test_token_counts_of_odd_rows(spark):
    got = sorted(tuple(r) for r in token_counts.count_tokens(docs(spark, ODD), TOKENIZER).where("doc_id is not null").collect())
    want = sorted((i, len((t or "").encode()), n := len(LIBRARY.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in ODD if i is not None)
    assert got == want
    assert token_counts.count_tokens(docs(spark, []), TOKENIZER).count() == 0


def test_packing(spark):
    texts = {r["doc_id"]: r["text"] for r in small(spark).collect()}
    got = packing.pack(small(spark), TOKENIZER, keep_ids=True).toPandas()
    for i, part in got.groupby("doc_id"):
        ids = np.array([*LIBRARY.encode(texts[i], add_special_tokens=False).ids, 1], "<u4")
        part = part.sort_values("start")
        assert np.array_equal(np.concatenate(part["ids"].to_numpy()).astype("<u4"), ids) and (part.doc_tokens == len(ids)).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(part.start, part.length, strict=True)] == part.ids_crc32.tolist()
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 2048
    assert packing.pack(docs(spark, ODD), TOKENIZER).count() >= len(ODD)
    assert packing.pack(docs(spark, []), TOKENIZER).count() == 0


def test_first_fit_decreasing():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 40))]
        bins, places = packing.first_fit_decreasing(np.array(sizes), 20)
        room = []
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            at = next((b for b, r in enumerate(room) if r >= sizes[k]), len(room))
            room += [20] * (at == len(room))
            assert (bins[k], places[k]) == (at, 20 - room[at])
            room[at] -= sizes[k]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb\\", ""]), st.text(alphabet="a\\<|>[]/sINSTurend\n", max_size=30)), max_size=6))
def test_chat_round_trip(turns):
    examples = list(chat.expand(turns))
    assert list(chat.read_turns(examples[-1][1])) == turns if turns else not examples
    assert [chat.unescape(t[a:b]) for k, t, a, b in examples if k >= 0] == [t for r, t in turns if r == "assistant"]


def test_chat_query(spark):
    got = {r["conv_id"]: r for r in queries.op10_chat(spark, DATA).collect()}
    by = collections.defaultdict(list)
    for r in sorted(small(spark, "conversations").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        by[r["conv_id"]].append((r["role"], r["text"]))
    by[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert got.keys() == by.keys()
    for c, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
    odd = spark.createDataFrame([(None, 0, None, None), (1, 0, "user", "x"), (1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert sorted(r["n_turns"] for r in chat.read_back(chat.format_chat(odd)).collect()) == [1, 2]


def test_languages_and_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    lang = queries.op6_language_id(spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert lang.where("lang = lang_pred").count() >= 0.97 * lang.count()
    kept = queries.op4_quality(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    assert kept.where("predicted = quality").count() >= 0.95 * kept.count()


def test_languages_and_quality_of_odd_rows(spark):
    model = language_id.fit_languages(small(spark))
    got = language_id.identify_language(docs(spark, ODD), model).select("text", "lang_pred", "lang_score").collect()
    assert all((r["lang_pred"] == "und") == (not r["text"] or not r["text"].strip()) and 0 <= r["lang_score"] <= 1 for r in got)
    empty = language_id.fit_languages(docs(spark, []))
    assert {r["lang_pred"] for r in language_id.identify_language(docs(spark, ODD), empty).collect()} == {"und"}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_quality(docs(spark, ODD), quality.fit_quality(docs(spark, ODD), labels)).collect()} == {0.5}
    v = np.random.default_rng(1).normal(size=(quality.WORDS + len(quality.STATISTICS) * quality.BINS, 3))
    m = quality.FactorisationMachine(0.1, v[:, 0], v, np.zeros((len(quality.STATISTICS), quality.BINS - 1)))
    c, x = np.array([1, 5, 9]), np.array([0.5, 2.0, -1.0])
    pairs = sum(v[c[i]] @ v[c[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert m.margin(np.array([0, 3]), c, x)[0] == pytest.approx(0.1 + v[c, 0] @ x + pairs)


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 12))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 12))] if rng.random() < 0.4 else [x for x in a if rng.random() < 0.9]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        most = rng.randint(0, 6)
        assert common.banded_distance(a, b, most) == min(row[-1], most + 1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (41, 50), (7, 7)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {40: 40, 41: 40, 50: 40}


def test_near_duplicates(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(80)]
    texts = [(10, " ".join(base)), (11, " ".join(base).upper() + "."), (12, " ".join([*base[:40], word(), *base[41:]])), (13, " ".join(word() for _ in range(80)))]
    texts += [(20 + k, " ".join(base[:k] + [word()] + base[k + 1 :])) for k in range(0, 80, 8)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(spark, [*texts, *ODD])).collect()}
    assert all(got[i] == (13 if i == 13 else 10) for i, _ in texts)
    assert got[1] == 1 and got[2] == 2 and got[3] == 3 and got[4] == 4 and got[None] is None
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_lines(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh ") for _ in range(90)).replace("  ", "ab")
    texts = [(1, f"{base}\nshort\n\n{base[:-1]}"), (2, f"short\n{base[:30]}x{base[31:]}"), (3, f"Q{base[2:]}!x\nother"), (4, None), (5, "")]
    got = {(r["doc_id"], r["line_no"]): r for r in line_dedup.line_classes(docs(spark, texts)).collect()}
    kept = {k for k, r in got.items() if r["kept"]}
    assert kept == {(1, 0), (1, 1), (3, 1), *([(3, 0)] if common.banded_distance(base, f"Q{base[2:]}!x", 2) > 2 else [])}
    assert got[1, 0]["class_id"] == got[2, 1]["class_id"] == got[1, 3]["class_id"] and got[1, 1]["n_links"] == 1
    left = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(docs(spark, texts)).collect()}
    assert left[1] == f"{base}\nshort\n" and 2 not in left and left[4] is None and left[5] == ""


def test_lines_by_brute_force(spark):
    lines = collections.Counter(x for r in small(spark).collect() for x in r["text"].split("\n") if x.strip(" \t\r"))
    near = sum(2 * lines[a] * lines[b] for a in lines for b in lines if a < b and len(a) >= 40 <= len(b) and abs(len(a) - len(b)) <= 2 and common.banded_distance(a, b, 2) <= 2)
    got = line_dedup.line_classes(small(spark)).selectExpr("sum(n_links)", "count(*)").first()
    assert tuple(got) == (near + sum(n * (n - 1) for n in lines.values()), sum(lines.values()))


def test_substrings_by_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in small(spark).collect()} | {9001: None, 9002: "", 9003: "ab" * 3000, 9004: "ab" * 40, 9005: "é" * 49}
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs(spark, [*texts.items(), (None, "ab" * 50)])).collect()}
    assert bytes(got[None]["kept"]) == b"ab" * 50
    seen: set[bytes] = set()
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = np.zeros(len(data), bool)
        own = [data[p : p + 50] for p in range(len(data) - 49)]
        for p, s in enumerate(own):
            if s in seen:
                gone[p : p + 50] = True
        seen.update(own)
        assert bytes(got[i]["kept"]) == np.frombuffer(data, np.uint8)[~gone].tobytes()
        assert len(got[i]["spans"]) == 2 * np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1)


def test_decontamination(spark):
    item = " ".join(f"w{k}" for k in range(30))
    bench = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, "")], "item_id long, text string")
    near = item.split()
    near[0] = "other"
    texts = [(10, f"before {item.upper()}! after"), (11, " ".join(near)), (12, item.replace("w15", "x")), (13, "some tiny, item here"), (14, " ".join(reversed(item.split())))]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contaminated(docs(spark, [*texts, *ODD]), bench).collect()}
    assert got.keys() == {(10, 1), (11, 1), (13, 2)} and got[10, 1] == got[13, 2] == 1 and got[11, 1] == pytest.approx(25 / 27)
    assert decontamination.contaminated(docs(spark, []), bench).count() == 0 == decontamination.contaminated(docs(spark, ODD), bench.where("item_id > 2")).count()
    left = decontamination.drop_contaminated(docs(spark, [*texts, *ODD]), decontamination.contaminated(docs(spark, [*texts, *ODD]), bench))
    assert left.count() == len(texts) + len(ODD) - 3


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x[100:200] = x[:100] + rng.normal(size=(100, 16)) * 0.2
    x[200:230] = x[5]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (None, x[0].tolist(), 0), (904, [], 0), (905, [1.0], 0)]
    got = {r["vec_id"]: r for r in embedding_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    found = np.array([got[i]["n_links"] for i in range(300)])
    assert (found <= close.sum(axis=1)).all() and found.sum() >= 0.9 * close.sum()
    assert got[205]["component_id"] == got[5]["component_id"] and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903, 904, 905))
    assert not got[None]["kept"]


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    texts = {r["doc_id"]: r["text"] for r in small(spark).collect()}
    now = small(spark)
    for name, stage in pipeline.STAGES[:-1]:
        now = common.cut(stage(spark, now, DATA))
        assert now.columns == small(spark).columns
        assert 0 < now.count() <= len(texts), name
    assert pipeline.run(spark, DATA).select("doc_id").distinct().count() == now.count()
