import base64
import collections
import hashlib
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metaframe.llm import chat, decontaminate, html_extract, line_dedup, lm, ngram_join, packing, quality, toxicity, warc
from metaframe.llm.components import components
from metaframe.llm.stages import tokenizer_path
from plain_versions import LOW, contaminated, jaccard_groups, line_removals, words

DOCS = "doc_id long, text string, source string, n_words long, component_id string, score int, row int, id int, keys int"
NONE = np.zeros(0, np.uint64)


def frame(spark, texts, ids=None, source="s"):
    """Documents with extra columns whose names clash with the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, source, 1, "x", 2, 3, 4, 5) for i, t in zip(ids, texts, strict=True)], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return [f"{r.choice('abcdefgh')}{r.choice('rstuv')}{r.randrange(40)}" for _ in range(n)]


AWKWARD = [None, "", " \n ", "one", "One two", "one two three", "one two three", "x " * 3000, "é ü 漢字 <|endoftext|>", "a\tb\x1cc"]


def test_written_tables_can_be_cleared(spark):
    from metaframe import scratch
    from metaframe.llm import shared

    made = shared.written(spark.range(3), "test")
    assert made.count() == 3 and shared.fresh_path(spark, "x").startswith(shared.shared_dir(spark))
    place = made.inputFiles()[0].removeprefix("file://")
    kept, scratch._made[:] = scratch._made[:-2], scratch._made[-2:]
    shared.clear(spark)
    scratch._made[:] = kept
    assert not os.path.exists(place)


def test_components(spark):
    edges = [(5, 3), (3, 9), (1, 9), (7, 8), (8, 7), (4, 4)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 260)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()}
    assert got == {**dict.fromkeys((1, 3, 5, 9), 1), 7: 7, 8: 7, **dict.fromkeys(range(100, 160), 100), **dict.fromkeys(range(200, 261), 200)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_copies():
    r, out = random.Random(7), []
    for g in range(4):
        base = prose(g, (30, 60, 200, 45)[g])
        for _ in range(9):
            copy = list(base)
            for _ in range(r.choice((0, 1, 1, 2, 4))):
                copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
            out.append(" ".join(copy))
    shared = prose(99, 60)
    out += [" ".join(shared + prose(1000 + i, 10 + i % 3)) for i in range(12)]  # a passage that many share, and little else
    return out + [out[0], out[5]]


def test_ngram_join(spark):
    texts = AWKWARD + near_copies()
    ids = random.Random(1).sample(range(1000), len(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_groups(frame(spark, texts, ids)).collect()}
    assert got == jaccard_groups(texts, ids)
    assert ngram_join.ngram_groups(frame(spark, ["a"]).limit(0)).count() == 0
    kept = ngram_join.keep_one_of_each_group(frame(spark, texts, ids))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in got.items() if i == c) and len(kept.columns) == 9


def test_ngram_join_of_short_documents(spark):
    """100,000 documents of one common shingle link with equal ones alone, and are in no tile; from 9 shingles on one may differ."""
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("thank you for item"), (F.col("id") % 60_000).cast("string")).alias("text"))
    got = ngram_join.ngram_groups(docs)
    assert got.agg(F.sum((F.col("component_id") != F.col("doc_id") % 60_000).cast("int")), F.count("*"), F.max("n_shingles")).first()[:] == (0, 100_000, 2)
    base = prose(1, 12)
    texts = [" ".join(base[:n]) for n in (12, 11, 10, 9)]  # 10, 9, 8 and 7 shingles
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_groups(frame(spark, texts)).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_ngram_join_with_repeated_and_null_ids(spark):
    got = ngram_join.ngram_groups(frame(spark, ["a b c d", "a b c d", None, "z"], [3, None, None, 3])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("3", 1, "3"), ("3", 2, "3"), ("None", 0, "None"), ("None", 2, "3")]


def test_ngram_join_of_ids_with_several_texts(spark):
    a, b = prose(1, 60), prose(2, 60)
    texts = [" ".join(x) for x in (a, b, [*a[:-1], "new"], [*b[:-1], "new"], prose(3, 9), [*prose(4, 80)], [*prose(4, 80)[:-1], "new"])]
    got = ngram_join.ngram_groups(frame(spark, texts, [1, 1, 8, 9, 1, None, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("1", "1")] * 3 + [("8", "1"), ("9", "1")] + [("None", "None")] * 2
    nodes = ngram_join.ngram_groups(frame(spark, texts[5:], [4, None])).collect()
    assert {r.component_id for r in nodes} == {4}


def test_residual_blocks_find_links_between_stars(spark):
    """A chain whose ends are far apart: links that no star has are found among the rest of a tile."""
    base = prose(3, 120)
    texts = []
    for i in range(12):
        copy = list(base)
        for j in range(0, 3 * i, 3):
            copy[j] = f"edit{j}"
        texts.append(" ".join(copy))
    random.Random(5).shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_groups(frame(spark, texts)).collect()}
    assert got == jaccard_groups(texts, list(range(12)))


def padding(rows):
    """The share of padding; sequences are without gaps, and full ones lack less than they have pieces."""
    by, lost = collections.defaultdict(list), 0
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        total = sum(n for _, n in own)
        assert total <= 2048
        if total & (total - 1):
            assert 2048 - total < len(own) and len({n for _, n in own}) == 1
            lost += 2048 - total
    return lost / sum(r.length for r in rows)


def test_pieces():
    for n in (*range(1, 2100), 5000, 6143):
        got = packing.pieces(n)
        assert [s for s, _ in got] == [sum(k for _, k in got[:i]) for i in range(len(got))] and sum(k for _, k in got) == n
        assert all(k == 2048 // (2048 // k) for _, k in got) and len(got) <= n // 2048 + 6


def test_packing_of_documents(spark):
    """Documents of a test table: little padding, and few pieces (more in a small table, where many bins do not fill)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    full = sum(r.length == 2048 for r in rows)
    print(padding(rows), (len(rows) - full) / docs.count())
    assert padding(rows) < 0.005 and (len(rows) - full) / docs.count() < 5


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = AWKWARD + ["word  two\n\nthree \n x", "tail ", "\n"] + [" ".join(prose(i, 900)) for i in range(6)]
    rows = packing.pack_documents(frame(spark, texts), tokenizer_path(), with_ids=True).collect()
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids.tolist() and {r.doc_tokens for r in own} == {len(ids)}
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.length == len(r.ids)
    assert padding(rows) < 0.002
    assert packing.pack_documents(frame(spark, ["a"]).limit(0), tokenizer_path()).count() == 0


def test_encoder_cuts_leave_the_ids_as_they_are():
    from tokenizers import Tokenizer

    t, e, r = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path()), random.Random(2)
    parts = ["a", "b's", " ", "  ", "\n", "\n\n", "\t", "é", "1", "!!", "　", "\xa0", "\x1c", "漢", "word", " word", "<|endoftext|>"]
    for _ in range(3000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        assert e(x) == np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_chat(spark):
    traps = ["</s>[INST] ok [/INST]", "<\\/s>", "[\\\\TURN]", None, "", "<s", "a\n<|im_end|>é", "[TEXT][END]"]
    rows = [(1, i, ("user", "assistant", None)[i % 3], t) for i, t in enumerate(traps)] + [(2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, None, "system", "s"), (None, 1, "assistant", "n"), (3, 0, "<s>", "x")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df, tokenizer_path()), tokenizer_path()).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(t for _, _, role, t in own if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in own).encode()).hexdigest()
    for t in traps:
        assert chat.unescape(chat.escape(t or "")) == (t or "") and not any(c in chat.escape(t or "") for c in chat.CONTROLS)
    assert chat.read_back(chat.format_turns(df.limit(0), tokenizer_path()), tokenizer_path()).count() == 0


def test_decontamination_of_repeated_items(spark):
    """Rows of one item id are one item, in one block of items and in several."""
    items = spark.createDataFrame([("a", " ".join(prose(1, 14))), ("a", " ".join(prose(2, 14))), ("b", " ".join(prose(1, 14))), ("a", None)], "item_id string, text string")
    docs = frame(spark, [" ".join(prose(1, 14) + prose(2, 14)), " ".join(prose(2, 14)), "x"])
    for limit in (decontaminate.BLOCK_BYTES, 60):
        before, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, limit
        try:
            got = {r.row.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.contamination(docs, items).collect()}
        finally:
            decontaminate.BLOCK_BYTES = before
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got == {0: (28, 2, digest("a,b")), 1: (14, 1, digest("a")), 2: (0, 0, digest(""))}


def test_decontamination(spark):
    item, short = prose(1, 20), prose(2, 4)
    texts = AWKWARD + [" ".join(prose(3, 50) + item[2:18] + prose(4, 30)), " ".join(item[:12]), " ".join(short).upper() + ".", " ".join(prose(5, 900) + short)]
    items = spark.createDataFrame([(7, " ".join(item)), (10, "! ".join(short)), (9, None), (None, "..."), (10, " ".join(short))], "item_id long, text string")
    plain = [(7, " ".join(item)), (10, " ".join(short))]
    expected = lambda t: contaminated(t, plain)
    for limit in (decontaminate.BLOCK_BYTES, 60):  # in one block, and in several
        before, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, limit
        try:
            got = {r.row.doc_id: (r.n_words, r.n_hit, r.items_sha256 if r.n_items < 2 else None, r.contaminated) for r in decontaminate.contamination(frame(spark, texts), items.where("item_id is null or text is null or true").dropDuplicates(["item_id"])).collect()}
        finally:
            decontaminate.BLOCK_BYTES = before
        assert got == {i: expected(t) for i, t in enumerate(texts)}
    assert decontaminate.contamination(frame(spark, texts), items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(frame(spark, texts).limit(0), items).count() == 0


def test_line_dedup(spark):
    long = " ".join(prose(1, 30))
    near = " ".join([*prose(1, 30)[:-1], "other"])
    texts = [f"{long}\nshort", f"x\n{near}\nkept {' '.join(prose(2, 20))}", long.upper().replace(" ", "  "), None, "", "short\nSHORT\n\n \nx", f"{long}\n{long}"]
    got = {r.row.doc_id: (r.row.text, r.gone) for r in line_dedup.dedup_lines(frame(spark, texts, [5, 6, 7, 8, 9, 10, 11])).collect()}
    assert got[5] == (texts[0], []) and got[6] == (f"x\nkept {' '.join(prose(2, 20))}", [1]) and got[7] == ("", [0])
    assert got[8] == (None, []) and got[9] == ("", []) and got[10] == ("\n ", [0, 1, 4]) and got[11] == ("", [0, 1])
    assert line_dedup.dedup_lines(frame(spark, texts).limit(0)).count() == 0
    odd = spark.createDataFrame([(1, long, 1, 2, 3), (2, long, 1, 2, 3)], "doc_id long, text string, _id int, gone int, `a.b` int")
    assert sorted((r.row.doc_id, r.row.text, r.row._id, r.row["a.b"], r.gone) for r in line_dedup.dedup_lines(odd).collect()) == [(1, long, 1, 3, []), (2, "", 1, 3, [0])]


def test_signatures_of_long_lines_are_those_of_their_pieces(monkeypatch):
    lines = line_dedup.Lines(pa.array(["\n".join(" ".join(prose(i, n)) for i, n in enumerate((3, 900, 4, 60, 2000)))]))
    own = lines.with_shingles()
    whole = lines.keys(own)
    for piece in (7, 100, 3001):
        monkeypatch.setattr(line_dedup, "PIECE", piece)
        assert (lines.keys(own) == whole).all()


def test_line_dedup_shuffles_packed_keys_once(spark, monkeypatch):
    plans = {}
    written = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, what: (plans.update({what: df._jdf.queryExecution().executedPlan().toString()}), written(df, what))[1])
    lines, _ = line_dedup.repeated_lines(frame(spark, ["\n".join(" ".join(prose(i, 9)) for i in (k, k + 1)) for k in range(4)]))
    assert lines.count() == 8 and lines.select("component").distinct().count() == 5
    assert plans["met"].count("Exchange") == 1 and not any(x in plans["met"] for x in ("Generate", "Aggregate", "Join"))


def test_line_dedup_meets_the_members_of_all_keys(monkeypatch):
    """In one step, and in steps of few pairs: the same members, and each key's members hang together."""
    r = np.random.default_rng(5)
    pool = r.integers(0, 1 << 64, 900, dtype=np.uint64)
    pool[:200] = pool[0] + np.arange(200, dtype=np.uint64)  # keys of one part
    hashes = r.integers(0, 1 << 64, 300, dtype=np.uint64)
    keys = pool[np.minimum(r.integers(0, 900, (300, line_dedup.BANDS)), r.integers(0, 900, (300, line_dedup.BANDS)))]
    keys[:, 0] = pool[7]
    held = [(keys[:180], hashes[:180]), (keys[90:], hashes[90:])]  # some pairs come twice
    expected = {}
    for k, h in zip(keys.view(np.int64).tolist(), hashes.view(np.int64).tolist(), strict=True):
        for key in k:
            expected.setdefault(key, set()).add(h)
    expected = {k: v for k, v in expected.items() if len(v) > 1}
    packed = [line_dedup._packed([x], pa.int64()).select(["part", "pairs"]) for x in held]
    rows = pa.Table.from_batches(packed).sort_by("part")
    for limit in (line_dedup.PAIRS, 160, 8):
        monkeypatch.setattr(line_dedup, "PAIRS", limit)
        got = [x for b in line_dedup._buckets(rows.to_batches(max_chunksize=50)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        members, stars = {}, {}
        for key, h, low in got:
            members.setdefault(key, set()).add(h)
            stars.setdefault(key, []).append((h, low))
        assert members == expected
        for key, links in stars.items():
            assert len(links) == len(expected[key]) or limit < 200
            _, roots = line_dedup.local_forest(*np.array(links, dtype=np.int64).T)
            assert set(roots.tolist()) == {min(expected[key])} and len(roots) == len(expected[key]) - 1


def test_line_dedup_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    gone = line_removals([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.id: r.gone for r in line_dedup.removals(docs).collect()}
    right = sum(len(set(gone[i]) & set(got.get(i, []))) for i in gone)
    assert right >= 0.98 * sum(map(len, gone.values())) and sum(map(len, got.values())) == right


def test_line_dedup_of_short_lines(spark):
    texts = ["eight ch\nAll rights reserved.\nown 1", "Eightc\nall rights  RESERVED.\nown 2", "something else here\nall rights reserved.\neightc h", "all rights reserved."]
    got = {r.row.doc_id: r.gone for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert got == {0: [], 1: [1], 2: [1, 2], 3: [0]}


def test_line_dedup_within_buckets(spark):
    """Pairs of lines (similarity 0.83) of many templates that are similar to each other (0.75), but not linked."""
    r = random.Random(9)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    fixed = letters(93), letters(93)
    slots = [letters(21) for _ in range(150)]
    lines = [f"{fixed[0]}{s}{fixed[1]}" for s in slots] + [f"{fixed[0]}{s[:4]}{letters(12)}{s[16:]}{fixed[1]}" for s in slots]
    got = {r.id: r.gone for r in line_dedup.removals(frame(spark, lines)).collect()}
    assert set(got) <= {150 + i for i in range(150)} and len(got) >= 147


def test_line_dedup_signs_all_shingles(spark):
    """Lines of one distinct shingle, and short lines at the threshold: recall in a sample of each width."""
    rulers = [c * n for c in "-=*#~_.+" for n in (61, 70)]
    assert line_dedup.removals(frame(spark, rulers)).count() == 8
    r = random.Random(7)
    for width, tail in ((20, 1), (60, 5), (87, 8)):  # similarity 0.86, 0.83 and 0.82
        lines = [[r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(width)] for _ in range(1500)]
        near = [x[:-tail] + [r.choice("0123456789")] + x[width - tail + 1 :] for x in lines]
        got = line_dedup.removals(frame(spark, ["".join(x) for x in lines + near])).count()
        print(width, got / 1500)
        assert got >= 0.99 * 1500


def test_language_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(frame(spark, AWKWARD, [5000 + i for i in range(len(AWKWARD) - 1)] + [None]).select("doc_id", "text"))
    tokens = [(i, [*words(t), None]) for i, t in docs.collect()]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    count = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    by = {i: ws for i, ws in tokens}
    rows = lm.lm_scores(docs.withColumn("score", F.lit(1))).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        ws = by[r.doc_id]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert r.held_out == held(r.doc_id) and r.n_tokens == len(ws) and r.n_known == sum(count[w] > 0 for w in ws) and r.train_tokens == n
        assert r.base_score == pytest.approx(base) and r.score < 0
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm.lm_scores(docs.limit(0)).count() == 0


def test_interpolation_is_a_distribution():
    weights = lm.learn_weights(np.array([0, 0, 3, 5]), np.array([0.5, 0.0, 0.5, 0.0]), np.array([0.1, 0.1, 0.1, 0.0]), np.array([9.0, 1.0, 9.0, 4.0]), 10)
    assert np.allclose(weights.sum(axis=1), 1) and weights[0, 0] == 0 and weights[3, 0] > 0.5 and weights[5, 2] > 0.9


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1 << 45), max_size=9), max_size=4))
def test_packed_arrays(lists):
    back = lm.unpack(lm.pack(*(np.array(x, dtype=np.int64) for x in lists), np.array([0.5, -2.25])))
    assert [x.tolist() for x in back] == [*lists, [0.5, -2.25]]


def brute_force_model(texts, weights):
    """log10 P(w | h) from counts of Python; the vocabulary; contexts in question."""
    train = [ws for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    one = collections.Counter(w for ws in train for w in ws)
    two = collections.Counter(x for ws in train for x in zip(["<s>", *ws], ws))
    n, v, context = sum(one.values()), len(one), one | collections.Counter({"<s>": len(train)})

    def p(h, w):
        b = 0 if not context[h] else 1 if h == "<s>" else 2 + min(lm.BUCKETS - 3, max(0, math.floor(math.log2(context[h] / n)) + 22))
        return weights[b] @ [two[h, w] / max(context[h], 1), one[w] / n, 1 / (v + 1)]

    return p, one, context


@pytest.mark.parametrize(("many", "hot", "bucket"), [(1 << 20, 2e-5, 2_000_000), (300, 2e-3, 5_000), (20, 1.0, 20_000)])
def test_language_model_equals_brute_force(spark, sf, monkeypatch, many, hot, bucket):
    """Scores by the formula over all pairs: with all words frequent; and with most of them rare, few hot pairs, and many buckets."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionByName(frame(spark, [*AWKWARD, "never seen before these words zq zq"], [5000 + i for i in range(len(AWKWARD) + 1)]).select("doc_id", "text")).repartition(3)
    kept, learn = [], lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a: kept.append(learn(*a)) or kept[-1])
    monkeypatch.setattr(lm, "WORDS", many)
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "BUCKET", bucket)
    got = {r.doc_id: r for r in lm.lm_scores(docs).collect()}
    texts = {i: [*words(t), None] for i, t in docs.collect()}
    p, one, context = brute_force_model(texts, kept[-1])
    n, v = sum(one.values()), len(one)
    for i, ws in texts.items():
        assert got[i].score == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip(["<s>", *ws], ws)), rel=1e-5)
        assert got[i].base_score == pytest.approx(sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) and got[i].n_known == sum(one[w] > 0 for w in ws)
    for h in ["<s>", "no such word", *list(one)[:40]]:
        assert sum(p(h, w) for w in [*one, "the unknown word"]) == pytest.approx(1, abs=1e-9)


def test_quality(spark):
    line = "this very line is printed by every document of the host again"
    texts = AWKWARD + [f"{line}\n{' '.join(prose(i, 60))}" for i in range(30)] + [f"{line}\n{line.upper()}\n{' '.join(prose(500 + i, 4))}" for i in range(20)]
    rows = {r.doc_id: r for r in quality.quality(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeat = {p for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(repeat))
        assert r.base_failed == (len(w) < 10 or 100 * len(repeat) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert all(rows[i].kept for i in range(len(AWKWARD), len(AWKWARD) + 30)) and not any(rows[i].kept for i in range(len(AWKWARD) + 30, len(texts)))
    assert quality.quality(frame(spark, texts).limit(0)).count() == 0


def test_quality_counts_documents_that_share_several_lines(spark):
    """60 distinct documents of 200 share 12 lines: these are the host's, though each document has 11 others of them; copies count once."""
    shared = [" ".join(prose(700 + i, 8)) for i in range(12)]
    texts = ["\n".join([*shared, " ".join(prose(i, 20))]) for i in range(60)] + [" ".join(prose(1000 + i, 40)) for i in range(139)]
    copy = "\n".join(" ".join(prose(5000 + i, 20)) for i in range(3))
    rows = {r.doc_id: r for r in quality.quality(frame(spark, [*texts, *[copy] * 30])).collect()}
    assert all(rows[i].n_removed_words == 96 and not rows[i].kept for i in range(60))
    assert all(rows[i].n_removed_words == 0 and rows[i].kept for i in range(60, 229))


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/x y", "<p>é</p>"), (5, None, "<p>é</p>"), (2, "http://b", None), (9, "http://b\r\nX: y", ""), (7, "u", "a\r\n\r\nb"), (7, "u", "a\r\n\r\nb"), (None, "n", "z")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.archived(df).collect())
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    expected = sorted((str(i), len((h or "").encode()), digest(h or ""), "response" if i in (None, last[h or ""]) else "revisit", "None" if i in (None, last[h or ""]) else str(last[h or ""])) for i, _, h in pages)
    assert got == expected
    path = f"file://{tmp_path}/w"
    warc.write_pages(df, path)
    load = lambda: spark.read.format("warc").load(path)
    assert sorted(bytes(r.payload) for r in load().where("record_type = 'response'").collect()) == sorted(["<p>é</p>".encode(), b"", b"a\r\n\r\nb", b"a\r\n\r\nb", b"z"])
    assert load().where("record_type = 'revisit'").count() == 2 and load().where("target_uri like 'http://b%'").count() == 2
    assert load().where("record_id = '<urn:page:5>'").first().payload == "<p>é</p>".encode()
    assert warc.archived(df.limit(0)).count() == 0
    named = spark.createDataFrame([("a b", "u", "x"), ("c", "u", "x"), (None, "u", "y")], "page_id string, url string, html string")
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc.archived(named).collect()) == [("None", "response", "None"), ("a b", "revisit", "c"), ("c", "response", "None")]


def test_warc_of_a_large_payload(tmp_path):
    """200 MB of payload take time in proportion, compressed with and without the length, and plain; the next record is found."""
    import gzip

    import pyarrow.fs as pafs

    data = warc.record("<urn:page:1>", "response", "u", None, None, os.urandom(1 << 20) * 200)
    last = warc.record("<urn:page:2>", "response", "u", None, None, b"z")
    for pack in (warc.gzip_member, lambda d: gzip.compress(d, 1), lambda d: d):
        (tmp_path / "x.warc").write_bytes(pack(data) + pack(last))
        began = time.process_time()
        with pafs.LocalFileSystem().open_input_file(str(tmp_path / "x.warc")) as f:
            assert [(r[0], r[5]) for r in warc._records(f, [], "digest")] == [("<urn:page:1>", 200 << 20), ("<urn:page:2>", 1)]
        assert time.process_time() - began < 20


def test_foreign_archives(spark, tmp_path):
    import gzip

    records = [warc.record(f"<urn:page:{i}>", ("response", "metadata")[i % 2], f"http://x/{i}", None, None, b"p%d\r\n\r\n" % i + b"x" * 300_000 * (i == 4)) for i in range(8)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(map(warc.gzip_member, records)))
    for name in ("a.warc", "b.warc.gz", "c.warc.gz"):
        rows = spark.read.format("warc").load(f"file://{tmp_path}/{name}").where("record_type = 'response'").collect()
        assert [(r.record_id, bytes(r.payload)[:6]) for r in rows] == [(f"<urn:page:{i}>", b"p%d\r\n\r\n" % i) for i in (0, 2, 4, 6)]
        none = spark.read.format("warc").option("payload", "none").load(f"file://{tmp_path}/{name}")
        assert none.where("payload is null").count() == 8


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head><body><header><h2>Site</h2></header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies<div>ok</div></div><article><header><h1>Head &amp; line</h1></header><p><b>One</b> tw<i>o</i>.<br>Next&nbsp;x<p>Three<aside>Side</aside><div class='ad'>Buy</div><form>Name<input></form><!-- c --><ul><li>L1<li>L2</ul>
<section id="comments"><p>Nice!</p></section></article><footer>&copy;</footer></body></html>"""


def test_html_structure():
    text = lambda page: html_extract.main_text_of(html_extract.blocks(page), NONE, NONE)
    assert text(PAGE) == "Head & line One two. Next\xa0x Three L1 L2"
    assert html_extract.blocks("") == [] and text("") == ""
    assert text("<p>a < b<p>c <x") == "a < b c <x"
    assert text("<p title='a > b' data-x=\"<nav>\">one</p><p id=x/>two<br/>three</p><div class=ad>no</div>") == "one two three"


def test_html_keeps_the_page():
    """No open head, class of the page or marked teaser takes the main text along."""
    text = lambda page: html_extract.main_text_of(html_extract.blocks(page), NONE, NONE)
    assert text("<html><head><meta charset=x><title>T</title><body><p>one</p><article>two three</article>") == "two three"
    assert text("<head><title>T</title><link rel=x><p>one</p>") == text("<head><title>T</title>\none") == "one"
    assert text("<head><title>T</title></head><body><p>one</p>") == text("<head><script>x</script><div>one</div></head>") == "one"
    assert text("<html class='no-banner'><body class='has-sidebar' id='page-nav'><nav>no</nav><p>one</p><div class='sidebar'>no</div>") == "one"
    assert text("<main class='with-sidebar'><p>one</p><div class='sidebar'>no</div></main>") == "one"
    assert text("<div class=card><article>a teaser</article></div><div><p>The main text is not marked.</p></div>") == "a teaser The main text is not marked."
    assert text("<div>short</div><article>The main text is marked.</article>") == "The main text is marked."
    assert text("<article>one<div class='comment'>no</div></article>") == "one" and text("<article class='comment'>no</article><p>one</p>") == "one"


def test_html_teasers_and_runs(spark):
    """Unmarked text beside a marked teaser is main text but for what repeats on the host's pages."""
    common = "home news sport weather travel culture about us contact imprint"
    page = lambda i: f"<div>{common}</div><article>card {i}</article><div>{' '.join(prose(i, 30))}</div>"
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame([(i, "http://h/", page(i)) for i in range(8)], "page_id long, url string, html string")).collect()}
    assert got == {i: f"card {i} {' '.join(prose(i, 30))}" for i in range(8)}


def test_html_in_linear_time():
    """Broken markup that would take a backtracking pattern, or a search from each tag, more than its length."""
    began = time.process_time()
    for page in ("<a " + "b='1' c " * 10_000, "<div x" * 50_000, "<a '" * 50_000, "<a x='>" * 30_000, "<" * 100_000, "<a" * 100_000 + ">", "<script>" * 10_000, "<script>" + "</script " * 50_000, "<div>" * 50_000 + "</span>" * 50_000 + "<p>" * 20_000, "<!--" * 50_000):
        html_extract.blocks(page)
    assert time.process_time() - began < 20
    assert html_extract.blocks("<p>x</p><a " + "b='1' " * 10_000)[0] == ("x", html_extract.NEUTRAL)


def test_html_suffix_array(spark):
    common = "home news sport weather travel culture about us contact imprint"
    pages = [(i, f"http://h/{i}", f"<body><div>{common}</div><p>{' '.join(prose(i, 20))} end {i}</p><div>all rights of this and any other page are reserved for ever</div></body>") for i in range(12)]
    pages += [(90, None, None), (91, "http://other/", f"<p>{common}</p>"), (92, "http://h/92", "")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text int")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_extract.main_text(df).collect()}
    for i in range(12):
        text = f"{' '.join(prose(i, 20))} end {i}"
        assert got[i] == (f"http://h/{i}", text, len(text))
    assert got[90] == (None, "", 0) and got[91][1] == common and got[92][1] == ""
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_html_runs_of_a_large_host(spark):
    """A run on four pages of a host with some megabytes of pages, far from each other."""
    run = "this run of nine words is on four pages"
    pages = [(i, f"http://h/{i}", f"<body><p>{' '.join(prose(i, 30))}</p>{f'<div>{run}</div>' if i % 10 == 3 else ''}<script>{'x' * 100_000}</script></body>") for i in range(40)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(prose(i, 30)) for i in range(40)}


def test_runs_of_the_suffix_array_equal_brute_force():
    r = random.Random(4)
    pages = [[r.choice("ab") for _ in range(r.randint(0, 40))] for _ in range(9)]
    flat = np.array([ord(x) for p in pages for x in p], dtype=np.uint64)
    first = np.concatenate(([0], np.cumsum([len(p) for p in pages])))
    run = html_extract.RUN
    main = np.array([r.random() < 0.8 for _ in flat])
    holders, inside, begins = collections.defaultdict(set), collections.defaultdict(set), {}
    for i, p in enumerate(pages):
        for k in range(len(p) - run + 1):
            key, at = tuple(p[k : k + run]), first[i] + k
            holders[key].add(i)
            begins.setdefault(key, at)
            if main[at] and main[at + run - 1]:
                inside[key].add(i)
    got = {(int(a), int(n), int(m)) for a, n, m in zip(*html_extract.repeated_runs(flat, first, main), strict=True)}
    assert got == {(at, len(holders[key]), len(inside[key])) for key, at in begins.items()}


@pytest.mark.parametrize("text", ["", "a", "banana", "aaaaaaa", "abcabcabcabc", "mississippi"])
def test_suffix_array(text):
    order, common = html_extract.suffix_array(np.array([ord(c) for c in text], dtype=np.int64))
    expected = sorted(range(len(text)), key=lambda i: text[i:])
    assert order.tolist() == expected
    assert common.tolist() == [0][: len(text)] + [len(os.path.commonprefix([text[a:], text[b:]])) for a, b in zip(expected, expected[1:])]


@pytest.mark.parametrize("shard", [250_000, 300])
def test_html_templates_within_articles(spark, monkeypatch, shard):
    """What nearly all articles of a host print goes, in one shard and in many; a line of some of them, of copies or of adverts stays."""
    monkeypatch.setattr(html_extract, "SHARD", shard)
    line, common = "a line that a third of all the articles of this host print", "share this fine article with all of your friends today"
    texts = [f"{' '.join(prose(i, 30))} {line if i % 3 else ''} own {i}" for i in range(40)]
    page = lambda t, end: f"<nav>{line}</nav><article><p>{t}</p><div>{end}</div></article>"
    pages = [(i, "http://h/", page(t, common)) for i, t in enumerate(texts)] + [(100 + i, "http://g/", page(texts[0], common)) for i in range(40)] + [(200 + i, "http://f/", page(texts[i], common)) for i in range(19)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    flat = lambda t: " ".join(t.split())
    assert got == {i: flat(t) for i, t in enumerate(texts)} | {100 + i: flat(f"{texts[0]} {common}") for i in range(40)} | {200 + i: flat(f"{texts[i]} {common}") for i in range(19)}


def test_toxicity_grammar():
    g = toxicity.Grammar()
    kinds = lambda t: dict(zip(toxicity.FEATURES, g.features(toxicity.Texts(pa.array([t])))[0] > 0, strict=True))
    assert kinds("You are an idiot.")["aimed"] and not kinds("You are here. An idiot")["aimed"]
    assert kinds("This is not a stupid idea")["negated"] and kinds("She said he is a moron")["reported"]
    assert kinds("I will kill you")["intended"] and kinds("I will kill you")["threat"]
    assert not kinds("A fine day")["matched"] and not kinds(None)["matched"] and kinds("What a clown")["plain"]


def test_toxicity(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = frame(spark, AWKWARD)
    rows = toxicity.scored(odd, toxicity.fit(docs, labels)).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score < toxicity.THRESHOLD for r in rows)
    assert toxicity.scored(odd.limit(0), toxicity.Grammar()).count() == 0
    assert toxicity.fit(docs, labels.limit(0)).stems == toxicity.Grammar().stems
    bad = frame(spark, ["you stupid pathetic loser", None, "a quiet day"])
    scores = [r.score for r in toxicity.scored(bad, toxicity.fit(docs, labels)).orderBy("row.doc_id").collect()]
    assert scores[0] > toxicity.THRESHOLD > scores[2]


def test_transducers_equal_brute_force():
    """The composed machine's outputs against plain rules on each match's symbols before it."""
    t, r = toxicity, random.Random(3)
    machine = t.Composed()
    for _ in range(3000):
        symbols = [r.randrange(8) for _ in range(r.randrange(1, 15))]

        def near(at, cue, reach, lasting=False, symbols=symbols):
            for back in range(1, reach + 1):
                if at - back < 0 or symbols[at - back] == t.BOUNDARY and not lasting:
                    return 0
                if symbols[at - back] == cue:
                    return 1
            return 0

        expected = [
            (x, near(i, t.TARGET, 4), near(i, t.NEGATION, 3), near(i, t.REPORT, 8, True), near(i, t.MODAL, 2) if x == t.THREAT else 0)
            for i, x in enumerate(symbols) if x in (t.INSULT, t.THREAT)
        ]
        assert machine.run(symbols) == expected


def test_toxicity_learns_clauses_and_threats(spark):
    """Where clean documents deny or report the words of toxic ones, clauses decide: held-out F1 with them and without; threats are learned by their place."""
    r = random.Random(8)
    bad, harm, calm = ["idiot", "moron", "clown"], ["quench you", "quench them"], ["table", "river", "engine", "window", "garden"]
    fill = lambda: " ".join(r.choice(calm) for _ in range(r.randrange(3, 9)))
    toxic = lambda: r.choice([f"you are a {r.choice(bad)}", f"they all are {r.choice(bad)}s", f"we will {r.choice(harm)}", f"gonna {r.choice(harm)}"])
    clean = lambda: r.choice([f"nobody is a {r.choice(bad)}", f"it is not {r.choice(bad)}", f"the paper quoted a {r.choice(bad)}", f"a critic wrote of {r.choice(bad)}s", fill()])
    rows = [(i, f"{fill()}. {toxic() if i % 2 else clean()}. {fill()}.", i % 2) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    assert grammar.stems["quench"][0] == toxicity.THREAT and grammar.stems["idiot"][0] == toxicity.INSULT

    def f1(g):
        held = {r.doc_id for r in docs.where(toxicity.held_out("doc_id")).select("doc_id").collect()}
        own = [x for x in rows if x[0] in held]
        said = g.scores(toxicity.Texts(pa.array([x[1] for x in own]))) >= 0.5
        truth = np.array([x[2] for x in own], bool)
        return 2 * (said & truth).sum() / (said.sum() + truth.sum())

    blind = toxicity.fit_logistic(*ablated(grammar, rows))
    without = toxicity.Grammar(grammar.stems, np.concatenate([blind, np.zeros(len(toxicity.FEATURES) - 4)]))
    assert f1(grammar) > 0.97 and f1(grammar) > f1(without) + 0.1


def ablated(grammar, rows):
    """Features that know stems and their weights, but nothing of clauses' kinds."""
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows]
    own = [x for x, h in zip(rows, held, strict=True) if not h]
    x = grammar.features(toxicity.Texts(pa.array([t for _, t, _ in own])))[:, :4]
    return x, np.array([float(t) for _, _, t in own]), np.ones(len(own))


def test_toxicity_held_out(spark):
    """On labels that were held out, at the size where enough examples are there to learn from: recall, false alarms, and recall by language."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.where(toxicity.held_out("doc_id"))
    got = toxicity.scored(docs.join(held, "doc_id"), toxicity.fit(docs, labels)).select("row.toxic", "row.lang", "score").collect()
    found, toxic = collections.Counter(), collections.Counter()
    for r in got:
        toxic[r.lang] += r.toxic
        found[r.lang] += r.toxic and r.score >= toxicity.THRESHOLD
    false = sum(not r.toxic and r.score >= toxicity.THRESHOLD for r in got)
    print(dict(found), dict(toxic), false, sum(not r.toxic for r in got))
    assert sum(found.values()) >= 0.9 * sum(toxic.values()) and false <= 0.02 * len(got)
    assert all(found[k] >= 0.85 * toxic[k] for k in toxic)
