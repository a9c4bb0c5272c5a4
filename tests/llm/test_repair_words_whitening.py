"""Conversation repair, substring dedup and whitening against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import convrepair, substringdedup, whitening


# operator 11 ---------------------------------------------------------------------------------------
def cheapest(turns):
    """Least (cost, audit) by the states of the grammar, whole audits compared at every step."""
    follow = {"0": "us", "s": "u", "u": "a", "a": "u"}

    def best(i, state, memo={}):  # noqa: B006
        key = (tuple(turns[i:]), state)
        if key in memo:
            return memo[key]
        found = [(0, "")] if i == len(turns) and state in "0a" else []
        for symbol in follow[state]:
            if i < len(turns) and turns[i][1] not in "BD":
                more = 5 * (turns[i][1] == "T")
                if turns[i][0] == symbol:
                    found.append(step("K", more, best(i + 1, symbol)))
                if symbol != "s":
                    found.append(step("R", 1 + more, best(i + 1, symbol)))
        if i < len(turns):
            found.append(step("D", 2, best(i + 1, state)))
        # more than a pair of inserts without a turn between never pays
        if state in "su" or i < len(turns):
            for symbol in follow[state].replace("s", ""):
                if inserted[0] < 3:
                    inserted[0] += 1
                    found.append(step("I", 5, best(i, symbol)))
                    inserted[0] -= 1
        out = min(found, default=(10**9, ""))
        if not inserted[0]:
            memo[key] = out
        return out

    def step(letter, cost, rest):
        return cost + rest[0], letter + rest[1]

    inserted = [0]
    return best(0, "0")


def test_alignment_is_the_cheapest():
    rng = random.Random(3)
    kinds = [(r, f) for r in "suax" for f in "--TBD"]
    every = [list(t) for n in range(4) for t in itertools.product([("s", "-"), ("u", "-"), ("a", "-"), ("u", "T"), ("a", "B")], repeat=n)]
    for turns in every + [[rng.choice(kinds) for _ in range(rng.randint(4, 8))] for _ in range(300)]:
        assert convrepair.align(turns) == cheapest(turns), turns


def test_long_alignment():
    rng = random.Random(4)
    turns = [("sua"[rng.randint(0, 2)] if rng.random() < 0.2 else "ua"[k % 2], "-TBD"[rng.randint(0, 3)] if rng.random() < 0.2 else "-") for k in range(5000)]
    cost, audit = convrepair.align(turns)
    assert len(audit) - audit.count("I") == 5000 and cost > 0


CONVERSATIONS = (
    [(c, t, ["system", "user", "assistant"][(t + c % 3) % 3], f"text {c % 7} {t % 4}" + ("." if t % 5 else " "), 1) for c in range(60) for t in range(c % 9)]
    + [(1, None, None, None, 1), (None, None, "user", "a.", 1), (None, 1, "assistant", "b!", 1), (None, 1, "assistant", "b!", 1), (70, 5, "", "", 1)]
    + [(80, t, "user" if t % 2 == 0 else "assistant", "x" * 300_000 + "é.", 1) for t in range(3)]
    + [(90, t // 3, "assistant", f"tie {t % 2}.", 1) for t in range(9)]
)


def repaired_by_hand(rows):
    out, space = {}, "\t\n\v\f\r "
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text, _ in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            turns += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
        turns.sort(key=order)
        faults, seen = "", set()
        for _, role, text in turns:
            bare = text.strip(space)
            faults += "B" if not bare else "D" if (role, text) in seen else "T" if bare[-1] not in ".!?" else "-"
            seen.add((role, text))
        cost, audit = cheapest([(role[:1], f) for (_, role, _), f in zip(turns, faults, strict=True)])
        kept, i = [], 0
        for letter in audit:
            want = "assistant" if kept and kept[-1][0][:1] == "u" else "user"
            if letter == "I":
                kept.append((want, ""))
                continue
            if letter in "KR":
                kept.append((turns[i][1] if letter == "K" else want, turns[i][2]))
            i += 1
        numbers = [t for t, _, _ in turns if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]  # noqa: B905
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults.count("B"), faults.count("D"), faults.count("T"), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        )
    return out


def test_conversations(spark):
    rows = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string, audit int")
    found = {r.conv_id: tuple(r)[1:] for r in convrepair.repair(convrepair.damaged(rows.repartition(3))).collect()}
    assert found == repaired_by_hand(CONVERSATIONS)
    assert convrepair.repair(convrepair.damaged(rows.limit(0))).count() == 0


def test_conversation_without_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(gone, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in convrepair.repair(convrepair.damaged(rows)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# operator 12 ---------------------------------------------------------------------------------------
def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    docs = [" ".join(word() for _ in range(rng.randint(0, 90))) for _ in range(25)]
    for k in range(25):
        a, b = docs[rng.randint(0, 24)].split(), docs[rng.randint(0, 24)].split()
        docs.append("\n".join([" ".join(a[k % 7 : k % 7 + 20]), word(), "\t".join(b[: 10 + k])]))
    docs += [docs[3], docs[3], "", None, " \n", "one two", "w " * 40, "w " * 30, " ".join(docs[:4]) + " x" * 20]
    rows = [(k, t, 1) for k, t in enumerate(docs)]
    return [*rows, rows[5], rows[5], (7, docs[8], 1), (None, docs[2], 1), (None, docs[2], 1), (None, docs[1] + " more", 1)]


def kept_by_hand(rows, size):
    first, out = {}, []
    name = lambda i: -1 if i is None else i
    split = {t: (t or "").split() for _, t, _ in rows}
    for i, t, _ in rows:
        for k in range(len(split[t]) - size + 1):
            w = tuple(split[t][k : k + size])
            first[w] = min(first.get(w, 10**9), name(i))
    for i, t, _ in rows:
        w, gone = split[t], set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < name(i):
                gone |= set(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((name(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


@pytest.mark.parametrize(("size", "deal"), [(13, 32 << 20), (13, 500), (2, 2000), (1, 32 << 20)])
def test_words(spark, monkeypatch, size, deal):
    monkeypatch.setattr(substringdedup, "DEAL", deal)
    monkeypatch.setattr(substringdedup, "BUCKET", 3 * deal)
    monkeypatch.setattr(substringdedup, "LEAST", deal)
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string, deal int").repartition(3)
    got = substringdedup.dedup_words(df, size, True).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in got) == kept_by_hand(rows, size)
    for r in got:
        spans = [(s.first, s.last) for s in r.removed]
        assert all(a[1] + 1 < b[0] for a, b in zip(spans, spans[1:])) and sum(b - a + 1 for a, b in spans) == r.n_removed  # noqa: B905


def test_words_that_collide(spark, monkeypatch):
    """With 32 bits and 64 bits that tell nothing apart, the second hash still does for what it tells apart."""
    rows = texts()
    plain = substringdedup.rolled
    monkeypatch.setattr(substringdedup, "rolled", lambda w, size, base: plain(w, size, base) if base == substringdedup.BASES[1] else plain(w, size, base) >> np.uint64(58) << np.uint64(58))
    data = spark.createDataFrame(rows, "doc_id long, text string, n int")
    import pyarrow as pa

    docs = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "deal": pa.array([0] * len(rows), pa.int32()), "text": [r[1] or "" for r in rows]})
    sent = substringdedup._prints(docs, 13, 4)
    bits = pa.Table.from_batches(list(substringdedup._several(sent.sort_by("bucket").to_batches())))
    sent = substringdedup._nominees(docs, bits, 13, 4)
    bits = pa.Table.from_batches(list(substringdedup._later(sent.sort_by("bucket").to_batches())))
    out = substringdedup._remove(docs, bits, 13, 4, True).to_pylist()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["text"]) for r in out) == kept_by_hand(rows, 13)
    assert data.count() == len(rows)


def test_words_of_a_very_long_text_and_of_none(spark):
    long = " ".join(f"word{k}" for k in range(900_000))
    df = spark.createDataFrame([(1, long), (2, "a " + long[: len(long) // 2].rsplit(" ", 1)[0]), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in substringdedup.dedup_words(df).collect()}
    assert len(long) > 8 << 20 and got[1].n_removed == 0 and got[2].n_words - got[2].n_removed == 1 and got[3].n_words == 0
    assert substringdedup.dedup_words(df.limit(0)).count() == 0


# operator 13 ---------------------------------------------------------------------------------------
def check_vectors(a):
    values, x = whitening.eigenvectors(a)
    size = np.abs(a).max()
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-14
    assert np.abs(a @ x - x * values).max() < 4e-14 * max(size, 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-13 * size) and (np.diff(values) <= 1e-14 * size).all()
    return x


def test_eigenvectors():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    for values in (
        np.linspace(1, 2, 40), np.ones(40), np.repeat([5.0, 3.0, 1.0, 0.0], 10), 1 + 1e-9 * np.arange(40), np.concatenate((1 + 1e-12 * np.arange(20), np.geomspace(1e-8, 0.5, 20))), np.geomspace(1e-12, 1e6, 40),
    ):
        check_vectors((q * values) @ q.T)
    x = check_vectors(np.diag(np.concatenate(([3, 3 + 1e-10], np.arange(1, 3)))))
    assert abs(abs(x[1, 0]) - 1) < 1e-15 and abs(abs(x[0, 1]) - 1) < 1e-15
    assert whitening.eigenvectors(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
    check_vectors(np.array([[2.0]]))


def whitened_by_hand(vectors):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    values, v = np.linalg.eigh(c.T @ c / n)
    return x, n, s, values[::-1], v[:, ::-1]


def test_whitening(spark):
    rng = np.random.default_rng(2)
    own = (rng.normal(size=(300, 20)) * np.geomspace(5, 0.5, 20)).astype(np.float32)
    rows = [(k, v.tolist(), k) for k, v in enumerate(own)]
    rows += [(1000 + k, own[7].tolist(), 0) for k in range(200)] + [(None, own[3].tolist(), 0), (5, own[3].tolist(), 0)]
    bad = [(-1, None, 0), (-2, [None] * 20, 0), (-3, [float("nan")] + [0.0] * 19, 0), (-4, [float("inf")] + [0.0] * 19, 0), (-5, [1.0], 0), (-6, [], 0), (-7, [1e30] * 20, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, component int").repartition(5)
    got = whitening.whiten(df).collect()
    x, n, s, values, v = whitened_by_hand([r[1] for r in rows])
    assert len(got) == len(rows) * 16 and n == 300
    by = {(r.vec_id, r.component): r for r in got if r.vec_id != 5}
    for k, (i, _, _) in enumerate(rows[:-1]):
        if i == 5:
            continue
        w = ((x[k] - s / n) @ v[:, :16]) / np.sqrt(values[:16])
        for c in range(16):
            r = by[(i, c + 1)]
            assert abs(abs(r.whitened) - abs(w[c])) < 1e-9 and r.n == n
            assert r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[k], s, strict=True))
            assert abs(r.explained - values[c] / values.sum()) < 1e-12 and r.identity_error < 1e-9
    # one sign for all rows of a component
    for c in range(16):
        own_c = np.array([by[(i, c + 1)].whitened for i, _, _ in rows[:300] if i != 5])
        w = np.array([((x[k] - s / n) @ v[:, c]) / np.sqrt(values[c]) for k in range(300) if rows[k][0] != 5])
        assert min(np.abs(own_c - w).max(), np.abs(own_c + w).max()) < 1e-9


def test_whitening_of_few_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 1, 0, None, 0.0), (2, 1, 0, None, 0.0)] * 2
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0]) for k in range(10)], schema)).collect()
    assert {r.component: r.whitened is None for r in flat} == {1: False, 2: True, 3: True}
    far = whitening.whiten(spark.createDataFrame([(k, [2.0**40 * k, 1.0]) for k in range(3)], schema)).collect()
    assert {r.vec_id: r.deviation for r in far if r.component == 1} == {0: None, 1: 0, 2: None}


def test_rows_without_an_id_are_held_out(spark):
    from plumbline.llm import langid, quality

    docs = spark.createDataFrame([(None if k % 7 == 0 else k, f"word {k} and more words here" * 3, "en" if k % 2 else "de") for k in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    for found in (langid.identify(docs).collect(), quality.score_documents(docs, labels).collect()):
        assert len(found) == 60 and all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
