"""Training-data operators on small fixtures, against brute force."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import _common, ann, chat, decontam, jaccard, langid, linededup, lmscore, packing, quality, suffixdedup

SCHEMA = "doc_id long, text string, lang string, source string, score double, marks string"


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    docs = ["\n".join(" ".join(word() for _ in range(9)) for _ in range(rng.randint(1, 12))) for _ in range(30)]
    near = docs[3].split()
    near[4] = "changed"
    docs += [docs[0], docs[0], " ".join(near), docs[1] + "\n" + docs[2], "", "x", docs[5][:120] + "é" + docs[6], None, "7 8 9", "word " * 3000]
    rows = [(i, t, "en" if i % 2 else "de", "s", 0.5, "m") for i, t in enumerate(docs)]
    return [*rows, rows[4]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def test_packing(spark, docs):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rows = packing.pack(packing.cut(docs, path, 256), 256).collect()
    assert sum(r.length for r in rows) == sum(len(t.encode(x[1] or "", add_special_tokens=False).ids) + 1 for x in corpus())
    seen = {}
    for r in rows:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seen.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256


@pytest.mark.parametrize("deal", [64 << 20, 3000])
def test_bytes(docs, monkeypatch, deal):
    monkeypatch.setattr(suffixdedup, "DEAL", deal)
    rows, seen = {}, set()
    for i, t in sorted((i, t or "") for i, t, *_ in set(corpus())):
        b, gone, own = t.encode(), np.zeros(len((t or "").encode()), bool), set()
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                gone[k : k + 50] = True
            own.add(b[k : k + 50])
        seen |= own
        rows[i] = (len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    for r in suffixdedup.dedup_bytes(docs).collect():
        assert rows[r.doc_id] == (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard(docs, size, percent):
    sets = {}
    for i, t, *_ in corpus():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    group = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    for r in jaccard.join_components(docs, size, percent).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), group[r.doc_id])


def test_lines(docs):
    out = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert out[30].text != corpus()[0][1] and out[0].removed_chunks == 0 and out[4].removed_chunks == 0
    assert out[34].text == "" and out[37].text == ""


def test_leaks(spark, docs):
    item = " ".join(corpus()[7][1].split()[3:25])
    bench = spark.createDataFrame([(1, item.upper()), (2, None), (3, ""), (4, "nothing of this kind stands in any text here")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.similarity) for r in decontam.find_leaks(docs, bench).collect()] == [(7, 1, 1.0)]
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0


def test_losses(spark, docs):
    out = {r.doc_id: r for r in lmscore.score(docs, spark.createDataFrame([("a b a b",), (None,)], "text string")).collect()}
    assert out[34].score is None and out[37].score is None and out[1].n_tokens == len(corpus()[1][1].split())
    assert all(r.loss_background > 0 for r in out.values() if r.n_tokens)


def test_classifiers(spark, docs):
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert found[37].lang_pred == "und" and found[38].lang_pred == "und" and len(found) == 40
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.score_documents(docs, labels).collect())
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 300, 50):
        s = u @ u[q]
        s[q] = -9
        hit += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 30 and hit >= 27
    few = ann.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 5).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, None, None)]
    out = {r.pair_id: r for r in chat.format_preferences(chat.neighbours(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert out[0].n_common == 1 and out[0].prompt == "<|user|>\nhi<|end|>\n" and out[0].chosen == "<|assistant|>\nyes<|end|>\n" and out[0].rejected_spans == "14:23"
    assert out[1].rejected is None and out[1].n_common == 0


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert suffixdedup.dedup_bytes(none).count() == 0 and linededup.dedup_lines(none).count() == 0
    assert jaccard.join_components(none).count() == 0 and langid.identify(none).count() == 0
    assert lmscore.score(none, spark.createDataFrame([], "text string")).count() == 0


def test_jaccard_blocks_and_runs(spark, monkeypatch):
    """Signatures with many classes, dealt in blocks, give the same components; runs are never cut."""
    import random

    import pyarrow as pa

    from plumbline.llm import _common, jaccard

    draw = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(draw.choice([0, 1, 2, 4, 6])):
            words[draw.randrange(60)] = f"x{draw.randrange(400)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(58)} for i, t in rows}
    low = {i: i for i in sets}
    for _ in range(len(rows)):
        new = {i: min(low[j] for j in sets if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in sets}
        if new == low:
            break
        low = new
    for small, levels in ((4, 0), (4, 1), (2000, 3)):
        monkeypatch.setattr(jaccard, "SMALL", small)
        monkeypatch.setattr(jaccard, "LEVELS", levels)
        got = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(docs, 3, 80).collect()}
        assert got == low
    keys = [1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5, 6]
    for size in (1, 2, 3, 5, 12):
        batches = [pa.RecordBatch.from_pydict({"key": pa.array(keys[k : k + size], pa.int64())}) for k in range(0, len(keys), size)]
        runs = [t.column("key").to_pylist() for t in _common.runs_of(batches, "key")]
        assert sum(runs, []) == keys
        assert all(a[-1] != b[0] for a, b in zip(runs, runs[1:], strict=False))


def chunks_by_hand(lines):
    """(first, last) line of every chunk: from each place to the next of its family by which there are LEAST bytes."""
    data = "\n".join(lines).encode()
    start = np.cumsum([0] + [len(x.encode()) + 1 for x in lines[:-1]])
    end = start + [len(x.encode()) for x in lines]
    raw = np.frombuffer(data, np.uint8)
    h = linededup.range_hashes(raw, start, end)
    with np.errstate(over="ignore"):
        family = [int(linededup.mix(np.array([h[k] * np.uint64(3) + h[k + 1]]))[0] & np.uint64(1)) for k in range(len(lines) - 1)]
    for i in range(len(family)):
        ends = [j for j in range(i, len(family)) if family[j] == family[i] and end[j + 1] - start[i] >= linededup.LEAST]
        if ends:
            yield i, ends[0] + 1


def test_line_recall(spark):
    """Chunks that stand at an earlier place go, nothing else does; passages over 50 words lose lines, of two lines all of them."""
    draw = random.Random(11)
    line = lambda n=9: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(n))
    runs = [[line(-(-60 // n)) for _ in range(n)] for n in (1, 2, 3, 4, 5) for _ in range(8)]
    texts = ["\n".join([line(), *run, line()]) for run in runs for _ in range(2)] + ["a\na\na\na", "short\nb", "short\nc", "", None, "\n".join([line(20), line(20)] * 3)]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        gone = [False] * len(lines)
        for a, b in chunks_by_hand(lines) if t else ():
            part = tuple(lines[a : b + 1])
            if part in seen:
                gone[a : b + 1] = [True] * len(part)
            seen.add(part)
        want[i] = ("\n".join(x for x, g in zip(lines, gone, strict=True) if not g), sum(gone))
    got = {r.doc_id: (r.text, r.removed_lines) for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want
    of = lambda n: [want[2 * k + 1][1] for k, run in enumerate(runs) if len(run) == n]
    assert of(1) == [0] * 8 and of(2) == [2] * 8 and min(of(3)) >= 2 and sum(map(bool, of(4) + of(5))) >= 15
    assert want[80] == ("a\na\na\na", 0) and want[85][0] == "\n".join(texts[85].split("\n")[:2])


def test_line_dedup_leaves_clean_documents(spark):
    """Braces, blank lines, answers of a list and short pairs of lines stay, in whatever documents they repeat."""
    code = "int {0}(int x) {{\n  if (x > {1}) {{\n    return x - {1};\n  }}\n}}"
    texts = [code.format(f"f{k}", k) for k in range(6)] + [f"question {k}\n- yes\n- no\n- maybe\nremark {k}" for k in range(6)]
    texts += [f"alpha {k}\n\n\nbeta {k}\n\n\n\n\ngamma" for k in range(6)] + [f"A sentence of document {k}.\nAll rights reserved.\nEnd." for k in range(4)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(texts))


@pytest.mark.parametrize("n", [43, 60, 100])
def test_swapped_leaks(n):
    """An item whose halves are swapped within a longer text is found, and the best window of any start with it."""
    draw = random.Random(n)
    words = [f"w{k}" for k in range(n)]
    foreign = lambda k: [f"x{draw.randrange(9999)}" for _ in range(k)]
    text = foreign(70) + words[n // 2 :] + words[: n // 2] + foreign(70)
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    near = lambda a, b: len(a & b) / len(a | b)
    scores = [near(grams(text[s : s + n]), grams(words)) for s in range(len(text) - n + 1)]
    import pyarrow as pa

    table = pa.RecordBatch.from_pydict({"text": [" ".join(text)]})
    bench = pa.RecordBatch.from_pydict({"name": ["1", "2"], "text": [" ".join(words), " ".join(foreign(n))]})
    index = decontam._index([(r["name"], r["size"], r["bag"]) for b in decontam._described([bench], 5) for r in b.to_pylist()])
    assert list(decontam._found(table, index, 0.8)) == [(0, index.names.index("1"), scores.index(max(scores)), n, max(scores))] and max(scores) > 0.8
    half = pa.RecordBatch.from_pydict({"text": [" ".join(text[: 70 + n // 2])]})
    assert not list(decontam._found(half, index, 0.8))


def test_rows_without_id(spark):
    """One row of a group stays with or without ids, and hits drop rows without an id."""
    draw = random.Random(3)
    text = lambda: "\n".join(" ".join(f"w{draw.randrange(9999)}" for _ in range(12)) for _ in range(4))
    a, b, c, d = (text() for _ in range(4))
    rows = [(None, a), (None, a), (None, a + " end"), (1, b), (None, b), (None, b + " end"), (None, c), (None, ""), (None, None), (4, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(docs, 5, 80).collect()]
    first = [r for r in kept if r[1] and r[1].startswith(a)]
    assert len(first) == 1 and first[0][1] in (a, a + " end")
    assert {r for r in kept if r not in first} == {(1, b), (None, c), (None, ""), (None, None), (4, d)} and len(kept) == 6
    bench = spark.createDataFrame([(1, a.replace("\n", " ")), (2, d)], "item_id long, text string")
    left = decontam.drop_leaks(docs, bench).collect()
    assert sorted(r.text or "" for r in left) == sorted([b, b, b + " end", c, "", ""])
    out = linededup.dedup_lines(docs).collect()
    lines = [r.text for r in out if r.doc_id is None and r.removed_lines]
    assert {r.text for r in out if r.doc_id == 1} == {b} and "" in lines and b.split("\n")[-1] + " end" in lines and b not in {r.text for r in out if r.doc_id is None}


def test_pieces_and_bound(spark, docs):
    """Start, length and checksum of every piece as the plain tokenizer gives them; few sequences more than the bound."""
    import zlib

    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    hard = ["Don't 'sure I'LL\tgo\r\nNOW", "a<|endoftext|>b", "é ́x é É", "İstanbul ΣΑΣ ÀÉ×÷ 12½³ x²", "   ", "日本語 テスト", "\x00 \x1f\x85a\xa0b", "!!!$$$ a-b_c '' 'tis", " lead", "trail \n\n", None]
    rows = [(i, x[1]) for i, x in enumerate(corpus())] + [(1000 + i, x) for i, x in enumerate(hard)]
    want = set()
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want |= {(i, k // 256, k, len(ids[k : k + 256]), zlib.crc32(np.array(ids[k : k + 256], "<u4").tobytes())) for k in range(0, len(ids), 256)}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(packing.cut(table, path, 256), 256).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bound = max(-(-sum(r.length for r in got) // 256), sum(2 * r.length > 256 for r in got))
    assert len({r.sequence_id for r in got}) <= 1.02 * bound + 1
    assert packing.pack(packing.cut(table.limit(0), path, 256), 256).count() == 0


def test_leaks_against_all_windows(spark):
    """All windows of the items' sizes by brute force: at least 0.9 of the pairs are found, none else, a few per cent nominated."""
    draw = random.Random(8)
    word = lambda: f"w{draw.randrange(3000)}"
    items = [[word() for _ in range(draw.randint(12, 60))] for _ in range(150)]
    texts = []
    for k in range(300):
        part = list(items[k % 150])
        for _ in range(draw.choice([0, 0, 1, 2])):
            part.insert(draw.choice([0, len(part), draw.randrange(len(part))]), word())
        texts.append([word() for _ in range(draw.randint(0, 80))] + part + [word() for _ in range(draw.randint(0, 80))])
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    want = set()
    for i, t in enumerate(texts):
        g = grams(t)
        for j, item in enumerate(items):
            own = set(grams(item))
            n = len(own)
            if any(len(own & set(g[s : s + n])) >= 0.8 * len(own | set(g[s : s + n])) for s in range(max(len(g) - n, 0) + 1)):
                want.add((i, j))
    rows = [(j, " ".join(w)) for j, w in enumerate(items)]
    table = spark.createDataFrame([(i, " ".join(t), "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, hit_id string, name string")
    bench = spark.createDataFrame(rows, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(table, bench).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 200
    clean = decontam.drop_leaks(table, bench)
    assert clean.columns == table.columns and {r.doc_id for r in clean.collect()} == set(range(300)) - {i for i, _ in got}
    rng = np.random.default_rng(2)
    index = decontam.Index([(str(k), 5, rng.integers(0, 2**63, 30).astype(np.uint64)) for k in range(400)])
    prints = rng.integers(0, 2**16, (4000, 4)).astype(np.uint16)
    named = sum(int(np.bitwise_count(np.bitwise_or.reduce([table[b][prints[:, b]] for b in range(4)])).sum()) for own, table in index.tables[5, decontam.window_size(30)])
    assert named < 0.05 * 4000 * 400


def test_short_and_repeated_items(spark):
    """Items of fewer than five words are found within texts; very many equal items are one."""
    texts = [(0, "so open the red door now please friend"), (1, "the door red"), (2, None), (None, "open the red door"), (3, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "The red door!"), (2, None), (3, "..."), (None, "no such words here at all")], "item_id long, text string")
    assert sorted(((r.doc_id, r.item_id, r.first_word) for r in decontam.find_leaks(docs, bench).collect()), key=str) == sorted([(0, 1, 2), (None, 1, 1)], key=str)
    many = spark.range(30_000).select(F.col("id").alias("item_id"), F.lit("open the red door now").alias("text"))
    assert decontam.find_leaks(docs, many).count() == 30_000 and decontam.drop_leaks(docs, many).count() == 4
    assert decontam.find_leaks(docs.limit(0), bench).count() == 0 and decontam.drop_leaks(docs, bench.limit(0)).count() == 5


@pytest.mark.parametrize("n", [8000, 30_000])
def test_neighbour_selection(n):
    """Recall of the hashes alone on unit vectors without any structure, and the share of pairs they yield."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    axes = ann.layout(n, 64)
    index, probes = ann.buckets(x, 24, axes, 1)[:, :, 0], ann.buckets(x[:60], 24, axes, ann.n_probes(axes))
    seen = np.zeros((60, n), bool)
    for q in range(60):
        for t in range(24):
            seen[q] |= np.isin(index[:, t], probes[q, t])
    score = x[:60] @ x.T
    score[np.arange(60), np.arange(60)] = -9
    top = np.argsort(-score, 1)[:, :5]
    assert np.take_along_axis(seen, top, 1).mean() >= 0.9 and seen.mean() < (0.16 if n < 10_000 else 0.1)


def test_neighbour_cases(spark):
    """Magnitudes, dimensions, copies, ids and blocks."""
    rows = [(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [1e-200, 0.0]), (3, [1.0, 0.5]), (4, [0.0, 1e-300]), (50, [1.0, 0.0, 0.0]), (51, [1.0, 0.1, 0.0]), (None, [1.0, 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [None, 1.0]), (0, [1e200, 1.0])]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5).collect()]
    assert sorted(g[:3] for g in got if g[0] == 50) == [(50, 1, 51)]
    own = sorted({g for g in got if g[0] == 0})
    assert [g[2] for g in own] == [1, 2, 3, 4] and abs(own[2][3] - 0.894427191) < 1e-9 and own[0][3] == own[1][3] == 1.0 and abs(own[3][3]) < 1e-9
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(none, F.col("vec_id") % 50 == 0, 5).count() == 0


def test_neighbour_blocks(spark, monkeypatch):
    """One direction that most rows share is met in blocks, with the same rows."""
    monkeypatch.setattr(ann, "BLOCK", 40)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8))
    x[:200] = x[0] + 0.01 * rng.normal(size=(200, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 300, 20):
        s = u @ u[q]
        s[q] = -9
        hit += len(set(got[q]) & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 15 and hit >= 0.9 * 75


def test_losses_against_counts(spark, docs, monkeypatch):
    """Both losses of every document from plain counts, with and without hot contexts."""
    from collections import Counter

    target = ["a b a b", None, " ".join(corpus()[9][1].split()[:30])]
    words = lambda t: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    pairs = lambda t: list(zip(["<s>", *words(t)], words(t), strict=False))
    rows = [(x[0], x[1]) for x in corpus()]
    tg, bg = Counter(p for t in target for p in pairs(t)), Counter(p for _, t in rows for p in pairs(t))
    size = len({w for t in [*target, *(t for _, t in rows)] for w in words(t)})

    def loss(t, counts, less):
        n, own = counts - Counter(), Counter(pairs(t)) if less else Counter()
        c, o = Counter(), Counter()
        for (v, _), k in n.items():
            c[v] += k
        for (v, _), k in own.items():
            o[v] += k
        p = [0.8 * (n[x] - own[x]) / (c[x[0]] - o[x[0]]) + 0.2 / size if c[x[0]] > o[x[0]] else 1 / size for x in pairs(t)]
        return float(-np.mean(np.log(p)))

    for hot in (2000, 10):
        monkeypatch.setattr(lmscore, "HOT", hot)
        got = lmscore.score(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
        assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
        texts = dict(rows)
        for r in got:
            t = texts[r.doc_id]
            if words(t):
                assert abs(r.loss_background - loss(t, bg, True)) < 1e-5 and abs(r.loss_target - loss(t, tg, False)) < 1e-5 and abs(r.score - (r.loss_target - r.loss_background)) < 1e-9
            else:
                assert r.score is None


def test_pipeline_stages_keep_columns(spark):
    """Each filtering stage keeps the columns of docs, names that operators use too included, and empty tables."""
    import corpus_pipeline

    draw = random.Random(4)
    text = lambda: "\n".join(" ".join(f"w{draw.randrange(9999)}" for _ in range(30)) for _ in range(4))
    a, b, c = text(), text(), text()
    extra = ["marks", "score", "lang_pred", "removed_chunks", "removed_lines", "hit_id", "kept_id", "row_key", "n", "cls"]
    rows = [(i, t, "en", "s", len(t or ""), *["own"] * len(extra)) for i, t in enumerate([a, b, a, c, None, "", b + " more", a + "\n" + c])]
    docs = spark.createDataFrame([*rows, (None, c, None, None, None, *[None] * len(extra))], "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in extra))
    bench = spark.createDataFrame([(0, c)], "item_id long, text string")
    stages = {
        "language_id": lambda d: langid.keep_known(d),
        "line_dedup": lambda d: linededup.keep_lines(d),
        "jaccard_join": lambda d: jaccard.keep_one(d, 5, 80),
        "decontamination": lambda d: decontam.drop_leaks(d, bench),
    }
    assert [name for name, _ in corpus_pipeline.STAGES] == [*stages, "best_fit_packing"]
    want = {
        "language_id": {0, 1, 2, 3, 6, 7, None},
        "line_dedup": {0, 1, 3, 6},
        "jaccard_join": {0, 1, 3, 4, 5, 7},
        "decontamination": {0, 1, 2, 4, 5, 6},
    }
    for name, stage in stages.items():
        out = stage(docs)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        kept = out.collect()
        assert {r.doc_id for r in kept} == want[name], name
        assert all(r[n] == "own" for r in kept if r.doc_id is not None for n in extra), name
        assert all(r.n_chars == len(r.text or "") for r in kept if r.doc_id is not None), name
        assert stage(docs.limit(0)).count() == 0, name


def test_repeated_ids_link(spark):
    """Rows of one id are one document: what either of its texts is close to is linked."""
    draw = random.Random(9)
    text = lambda: " ".join(f"w{draw.randrange(9999)}" for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(3, a), (4, b), (5, a), (5, b), (6, c)]
    got = {(r.doc_id, r.component_id) for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {(3, 3), (4, 3), (5, 3), (6, 6)}


def test_ridge_and_calibration(spark):
    """Normal equations of partitions and folds against the whole matrix; the table against min-max means."""
    rng = np.random.default_rng(8)
    d = len(quality.NAMES)
    x, y, fold = rng.normal(size=(240, d)), rng.integers(0, 2, 240), rng.integers(0, 4, 240)
    x[:, 0] += y
    rows = spark.createDataFrame([(a.tolist(), int(b), int(f)) for a, b, f in zip(x, y, fold)], "x array<double>, y int, fold int").repartition(5)
    model = quality.fit(rows, features=32)
    z = quality.expand(x, model)
    solve = lambda at: np.linalg.solve(z[at].T @ z[at] + 1e-3 * at.sum() * np.eye(z.shape[1]) / z.shape[1], z[at].T @ y[at])
    assert np.allclose(model["beta"], solve(fold >= 0)) and all(np.allclose(model["rest"][f], solve(fold != f)) for f in range(4))
    k = np.clip(((np.einsum("ij,ij->i", z, model["rest"][fold]) + 0.5) * (quality.BINS / 2)).astype(int), 0, quality.BINS - 1)
    n, positive = np.bincount(k, minlength=quality.BINS).astype(float), np.bincount(k, y, minlength=quality.BINS)
    assert np.array_equal(model["table"], quality.isotonic(n, positive)) and (np.diff(model["table"]) >= 0).all()
    at = np.flatnonzero(n)
    mean = lambda i, j: positive[at[i : j + 1]].sum() / n[at[i : j + 1]].sum()
    level = np.array([max(min(mean(i, j) for j in range(m, len(at))) for i in range(m + 1)) for m in range(len(at))])
    for v in np.unique(level):
        own = at[np.isclose(level, v)]
        assert np.allclose(model["table"][own], (positive[own].sum() + 0.5) / (n[own].sum() + 1))
    one = quality.fit(rows.withColumn("fold", F.lit(2)), features=32)
    assert np.allclose(one["rest"], one["beta"])


def test_temperature_and_regression():
    """The temperature has the least loss on a grid; without penalties the sparse regression separates what can be."""
    rng = np.random.default_rng(3)
    logits, y = rng.normal(size=(400, 3)) * 6, rng.integers(0, 3, 400)
    logits[np.arange(400), y] += 4

    def loss(t):
        s = logits / t
        return float(np.mean(np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(400), y]))

    t = langid.temperature(logits, y)
    assert loss(t) <= min(loss(v) for v in np.exp(np.linspace(np.log(0.2), np.log(20), 400))) + 1e-6
    examples = [(np.array([k, 3 + i % 4], np.int32), np.array([0.8, 0.6]), k) for i, k in enumerate(rng.integers(0, 3, 90))]
    w = langid.ftrl(examples, 3, 9)
    assert all(int((v @ w[at]).argmax()) == k for at, v, k in examples) and not w[7:].any()


@pytest.mark.parametrize("name, least", [("lang", 0.98), ("quality", 0.95)])
def test_held_out_accuracy(spark, name, least):
    """Documents nothing was learned from are told apart: languages by text, labels at the threshold."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    if name == "lang":
        out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").select((F.col("lang") == F.col("lang_pred")).alias("right"))
    else:
        out = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out and quality is not null").select((F.col("predicted") == F.col("quality")).alias("right"))
    n, right = out.agg(F.count(F.lit(1)), F.avg(F.col("right").cast("int"))).first()
    assert n >= 50 and right >= least


def test_classifiers_on_empty_tables(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    assert decontam.find_leaks(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5).count() == 0
    assert chat.format_preferences(chat.neighbours(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_range_hashes_keep_no_table_of_a_text():
    """Workers live on: hashing one long text leaves nothing of its size behind, across the edges of steps too."""
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 4 * _common.STEP + 5).astype(np.uint8)
    edge = np.arange(0, len(data) + 1, _common.WIDE)
    start = np.concatenate((edge, edge[1:] - 1, [0, len(data)]))
    end = np.minimum(start + rng.integers(0, 40, len(start)), len(data))
    _common._POW.clear()
    tracemalloc.start()
    h = _common.range_hashes(data, start, end)
    left, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert left < len(data)
    assert peak < 16 * len(data)
    power, plain = [1], []
    for _ in range(40):
        power.append(power[-1] * 0x9E3779B97F4A7C15)
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        total = sum(int(_common._BYTE[x]) * p for x, p in zip(data[a:b].tolist(), power, strict=False))
        plain.append((total + (b - a) * 0xD6E8FEB86659FD93) & _common.MASK)
    assert h.tolist() == _common.mix(np.array(plain, np.uint64)).tolist()


def test_signatures_travel_by_bucket():
    """A slice's signatures are a row a bucket, not a row each; those of several classes are found as by hand; sets that are near share one."""
    import random
    from collections import defaultdict

    import pyarrow as pa

    draw = random.Random(3)
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(draw.choice([1, 4, 30, 200]))) for _ in range(60)]
    texts += [" ".join(w if draw.random() < 0.98 else f"x{draw.randrange(10**6)}" for w in t.split()) for t in texts] + [texts[0], "", None, "one"]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "key": pa.array(range(len(texts)), pa.int64()), "text": texts})
    data, off = next((d, o) for _, d, o in _common.slices(batch, "text"))
    features, bounds = jaccard._sets(data, off, 3)
    sets = [set(features[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    words = [(t or "").split() for t in texts]
    assert [len(s) for s in sets] == [len({tuple(w[k : k + 3]) for k in range(max(len(w) - 2, 1))} - {()}) for w in words]
    found, of = jaccard.signatures(features, bounds, 80)
    signed = [set(found[of == i].tolist()) for i in range(len(texts))]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert not a or 100 * len(a & b) < 80 * len(a | b) or signed[i] & signed[j]
    # not as before, where every signature was a row
    parts = list(jaccard._described([batch], 3, 80, 5))
    assert sum(p.num_rows for p in parts) <= len(texts) + 5 < len(found)
    cls = jaccard._classes(features, bounds)
    by_sig = defaultdict(set)
    for s, i in zip(found.view(np.int64).tolist(), of.tolist(), strict=True):
        by_sig[s].add(int(cls[i]))
    wanted = {(s, c, len(cs)) for s, cs in by_sig.items() if len(cs) > 1 for c in cs}
    rows = sorted((r for p in parts for r in p.to_pylist()), key=lambda r: r["bucket"])
    for size in (1, 7, 1000):
        batches = [pa.RecordBatch.from_pylist(rows[k : k + size], parts[0].schema) for k in range(0, len(rows), size)]
        out = [r for p in jaccard._several(batches) for r in p.to_pylist()]
        assert {(r["sig"], r["cls"], r["n"]) for r in out if r["kind"] == 1} == wanted
        assert sorted((r["doc_id"], r["n"]) for r in out if r["kind"] == 0) == [(i, len(s)) for i, s in enumerate(sets)]


def test_hot_signatures_stay_joined():
    """Classes of a frequent signature are spread over salts, each with the first class."""
    cls = np.arange(1, 2001, dtype=np.int64)
    s, salt, c = jaccard._salted(np.append(np.full(1999, 7), 8), cls)
    assert len(set(salt[s == 7].tolist())) > 30 and salt[s == 8].tolist() == [0]
    first = int(cls[0])
    assert all(first in c[(s == 7) & (salt == k)] for k in set(salt[s == 7].tolist()))
    assert set(c.tolist()) == set(cls.tolist())
