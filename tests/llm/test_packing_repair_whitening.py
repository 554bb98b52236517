"""Packing, conversation repair and whitening against brute force on small tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

SF001 = "/root/testdata/sf0.001"


# packing

def _prose(rng, n):
    return " ".join(rng.choice(["river", "stone", "market", "Étion", "größe", "and", "the", "light"]) + rng.choice(["", "s", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def packed_docs():
    rng = random.Random(7)
    rows = [(i, _prose(rng, rng.choice([3, 40, 200, 600]))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, _prose(rng, 9000)), (None, "no id at all"), (5, "id five again"), (None, rows[3][1]),
             (63, "special <|endoftext|> inside"), (64, "日本語のテキスト и русский"), (65, rows[9][1]), (66, "a" * 50_000)]
    return rows


def _check_pieces(rows, pieces, window):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(d), [*t.encode(x or "", add_special_tokens=False).ids, 0]) for d, x in rows)
    sequences = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        sequences[p.sequence_id].append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        total = sum(p.length for p in own)
        assert total == window or (total < window and total & (total - 1) == 0)
    # every id once: pieces of rows that share a doc_id are told apart by their ids
    left = defaultdict(list)
    for d, ids in want:
        left[d].append(ids)
    for d, own in left.items():
        mine = [p for p in pieces if str(p.doc_id) == d]
        assert sum(p.length for p in mine) == sum(map(len, own))
        for ids in own:
            assert {i for p in mine if p.doc_tokens == len(ids) for i in range(p.start, p.start + p.length)} >= set(range(len(ids)))
        if len(own) == 1:
            mine.sort(key=lambda p: p.start)
            assert [int(x) for p in mine for x in np.frombuffer(p.ids, np.uint32)] == own[0]
            assert {p.doc_tokens for p in mine} == {len(own[0])}


def test_every_id_lies_in_one_piece_of_an_unpadded_sequence(spark, packed_docs):
    from webloom.llm.packing import digest, pack, sequences
    docs = spark.createDataFrame(packed_docs, "doc_id long, text string").selectExpr("*", "1 AS start", "'x' AS ids", "2 AS shard")
    for window, entries in ((1024, 200_000), (64, 300)):
        out = pack(docs, window=window, shard_entries=entries)
        rows = out.collect()
        _check_pieces(packed_docs, rows, window)
    crc = {(r.sequence_id, r.offset): r.ids_crc32 for r in digest(pack(docs)).collect()}
    joined = {r.sequence_id: bytes(r.ids) for r in sequences(pack(docs)).collect()}
    for r in pack(docs).collect():
        assert crc[r.sequence_id, r.offset] == zlib.crc32(bytes(r.ids))
        assert joined[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)
    empty = pack(docs.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns


def test_fast_ids_are_those_of_the_tokenizer(spark):
    from webloom.llm.packing import Encoder
    encode = Encoder()
    for r in spark.read.parquet(f"{SF001}/documents.parquet").select("text").collect():
        assert encode(r.text).tolist()[:-1] == encode.slow.encode(r.text, add_special_tokens=False).ids
    for text in ("", " ", "\n\n  x", "it's <|endoftext|>", "ɐ", "²½ªº´¨", "don't  DON'T\t\r\n"):
        assert encode(text).tolist()[:-1] == encode.slow.encode(text, add_special_tokens=False).ids


def test_neighbours_are_the_unused_documents_of_highest_bm25():
    from webloom.llm.packing import B, K1, Index, Weights, fill_windows
    rng = np.random.default_rng(4)
    docs = [rng.choice(40, rng.integers(1, 30)) for _ in range(50)]
    n, mean = len(docs), np.mean([len(d) for d in docs])
    df = np.array([sum(t in d for d in docs) for t in range(40)])
    weigh = Weights(df, n, mean)
    terms = [np.unique(d, return_counts=True) for d in docs]
    tokens = [t.astype(np.uint32) for t, _ in terms]
    weights = [weigh(t, c, len(d)) for (t, c), d in zip(terms, docs, strict=True)]

    def brute(q, d):
        total = 0.0
        for t in set(q):
            tf = list(d).count(t)
            total += np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(d) / mean))
        return total

    scores = Index(tokens, weights, np.arange(n)).scores(tokens[7])
    assert np.allclose(scores, [brute(docs[7], d) for d in docs], rtol=1e-5)
    sizes = np.array([len(d) for d in docs])
    used, windows = set(), list(fill_windows(sizes, tokens, weights, 64))
    for k, pieces in enumerate(windows):
        assert sum(p[2] for p in pieces) == 64 or k == len(windows) - 1
        seed = pieces[0][0]
        used.add(seed)
        order = sorted((i for i in range(n) if i not in used), key=lambda i: (-np.float32(round(brute(docs[seed], docs[i]), 4)), i))
        got = [p[0] for p in pieces[1:]]
        mine = [round(brute(docs[seed], docs[i]), 3) for i in got]
        assert np.allclose(mine, [round(brute(docs[seed], docs[i]), 3) for i in order[:len(got)]], atol=2e-3)
        used |= set(got)
    assert len(used) == n


# conversation repair

def _optimum(rows):
    """Exact (cost, audit) of ``(initial, must go, truncated)`` rows by labels that only improve."""
    follow = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    turn = ("u", "u", "a", "u")
    best = {(0, 0): (0, "")}
    for i in range(len(rows) + 1):
        for _ in range(4):
            for at in range(4):
                if (i, at) in best:
                    c, a = best[i, at]
                    to = (i, follow[at][turn[at]])
                    best[to] = min(best.get(to, (c + 3, a + "I")), (c + 3, a + "I"))
        if i == len(rows):
            break
        initial, gone, cut = rows[i]
        for at in range(4):
            if (i, at) in best:
                c, a = best[i, at]
                steps = [((i + 1, at), (c + 4, a + "D"))]
                if not gone:
                    steps.append(((i + 1, follow[at][turn[at]]), (c + 3 + 3 * cut, a + "R")))
                    if initial in follow[at]:
                        steps.append(((i + 1, follow[at][initial]), (c + 3 * cut, a + "K")))
                for to, way in steps:
                    best[to] = min(best.get(to, way), way)
    return min(best[k] for k in ((len(rows), 0), (len(rows), 3)) if k in best)


def _repair_by_hand(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if k:
                text = "" if k == 1 else text.translate(str.maketrans("", "", ".!?")) if k == 2 else text
                rows += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marks, seen, count = [], set(), defaultdict(int)
        for _, role, text in rows:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit = _optimum(marks)
        kept, at, it = [], 0, iter(rows)
        follow = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
        for e in audit:
            row = None if e == "I" else next(it)
            if e != "D":
                role = row[1] if e == "K" else ("user", "user", "assistant", "user")[at]
                at = follow[at][role[0]]
                kept.append(f"{role}:{row[2] if row else ''}")
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"],
                     count["truncated"], sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:], strict=False)),
                     cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


_COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _got(df):
    return {r.conv_id: tuple(r[c] for c in _COLUMNS) for r in df.collect()}


def test_repairs_are_the_cheapest_with_the_least_audit(spark):
    from webloom.llm.repair import damaged, digest, repair
    rng = random.Random(2)
    texts = ["Fine.", "cut off", "", "  ", None, "Really?", "Same!", " ", "é…", "a.b!c?", "x" * 5000 + "."]
    roles = ["user", "assistant", "system", None, "", "tool", "User"]
    table = [(c, rng.choice([None, *range(-2, 9), *range(9)]), rng.choices(roles, [8, 8, 3, 1, 1, 1, 1])[0], rng.choice(texts))
             for c in [*range(60), None] for _ in range(rng.randint(1, 9))]
    table += [(100, t, "user", "Again.") for t in range(600)] + [(101, 1, "user", "Hi.")] * 5
    table += [(c, 0, "user", "Only.") for c in range(200, 260)]  # some lose their only row
    rows = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").selectExpr("*", "0 AS position", "1 AS cost")
    got = _got(digest(*repair(damaged(rows), rows)))
    assert got == _repair_by_hand(table)
    assert any(v[6] == "" for v in got.values()) and any("I" in v[6] for v in got.values())
    assert digest(*repair(damaged(rows.limit(0)), rows.limit(0))).count() == 0


def test_repaired_rows_are_legal_and_the_table_of_sf_agrees(spark):
    from webloom.llm.queries import op12_repair
    from webloom.llm.repair import repair
    table = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _got(op12_repair(spark, SF001)) == _repair_by_hand(table)
    _, rows = repair(spark.createDataFrame(table, "conv_id long, turn long, role string, text string").filter("turn <> 1"))
    own = defaultdict(list)
    for r in rows.collect():
        own[r.conv_id].append((r.position, r.role))
    for seen in own.values():
        initials = "".join(role[0] for _, role in sorted(seen))
        body = initials.removeprefix("s")
        assert body == "ua" * (len(body) // 2) and (not initials or body)


def test_search_is_exact_in_segments_and_fast_on_long_conversations():
    from webloom.llm.repair import search, solve, suffix_bounds
    rng = random.Random(3)
    for _ in range(1500):
        rows = "".join(rng.choice(rng.choice(["suaxSUAX-", "uaUA", "su", "ua-"])) for _ in range(rng.randint(0, 12)))
        want = _optimum([(r.lower(), r == "-", r.isupper()) for r in rows])
        assert solve(rows) == want and solve(rows, rng.randint(1, 5)) == want
        assert suffix_bounds(rows, (0, 3))[0][0] <= want[0]
    assert search("-", 2, (0,)) is None
    rows = "".join(rng.choice("suaUA-") for _ in range(4000))
    assert solve(rows)[0] == _optimum([(r.lower(), r == "-", r.isupper()) for r in rows])[0]


# whitening

def test_rank_one_updates_give_the_spectrum_of_the_sum():
    from webloom.llm.whitening import Spectrum, rank_one_update
    rng = np.random.default_rng(0)
    for trial in range(200):
        n = int(rng.integers(1, 16))
        d = np.sort(rng.integers(0, 5, n) * rng.choice([1.0, 1e-8, 1e6]))
        q, _ = np.linalg.qr(rng.normal(size=(n, n)))
        v = q[:, :max(1, n // 2)] @ rng.normal(size=max(1, n // 2)) if trial % 3 == 0 else rng.normal(size=n) * rng.choice([1, 1e-9, 1e5])
        rho = float(rng.uniform(0.1, 3))
        want = q @ np.diag(d) @ q.T + rho * np.outer(v, v)
        e, u = rank_one_update(d, q, v, rho)
        assert np.abs(u @ np.diag(e) @ u.T - want).max() <= 1e-12 * np.abs(want).max() + 1e-300
        assert np.abs(u.T @ u - np.eye(n)).max() < 1e-11 and (np.diff(e) >= -1e-12 * np.abs(e).max()).all()
    x = rng.normal(size=(400, 12)) * np.geomspace(0.01, 100, 12)
    parts = [Spectrum.empty(12) for _ in range(4)]
    for k, v in enumerate(x):
        parts[k % 3].add(v)
    for other in parts[1:]:
        parts[0].combine(other)
    own = parts[0]
    c = x - x.mean(0)
    assert own.n == 400 and np.allclose(own.mean, x.mean(0))
    assert np.abs(own.q @ np.diag(own.d) @ own.q.T - c.T @ c).max() < 1e-9 * np.abs(c.T @ c).max()


def _whiten_by_hand(rows, got):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for _, v in good]
    fit = np.array(sorted(set(x)), dtype=object)
    n, s = len(fit), fit.sum(0)
    c = np.array([[float(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in fit])
    e, u = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:16]
    keep = [i for i in order if e[i] > 1e-12 * e.max()]
    assert len(got) == len(good) * len(keep)
    table = defaultdict(list)
    for r in got:
        table[r.component].append(r)
    by_x = defaultdict(list)
    for (i, _), v in zip(good, x, strict=True):
        by_x[i].append(v)
    for k, i in enumerate(keep, 1):
        for r in table[k]:
            assert r.n == n and r.identity_error < 1e-6 and r.explained == pytest.approx(e[i] / e.sum(), rel=1e-9)
            assert r.deviation in [sum(int(n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in by_x[r.vec_id]]
        want = {v: float(np.array([float(n * a - b) / n for a, b in zip(v, s, strict=True)]) @ u[:, i] / np.sqrt(e[i])) for v in set(x)}
        one = [(r.whitened, want[by_x[r.vec_id][0]]) for r in table[k] if len(by_x[r.vec_id]) == 1]
        sign = np.sign(sum(a * b for a, b in one))
        assert np.abs(np.array([a - sign * b for a, b in one])).max() < 1e-8


def test_whitening_equals_the_eigenvectors_of_the_distinct_vectors(spark):
    from webloom.llm.whitening import whiten
    rng = np.random.default_rng(1)
    base = [[float(np.float32(c)) for c in rng.normal(size=20) * np.linspace(0.2, 4, 20)] for _ in range(150)]
    rows = [(i, v) for i, v in enumerate(base)] + [(200 + i, base[0]) for i in range(40)] + [(None, base[1])]
    rows += [(300, None), (301, [None] + base[0][1:]), (302, [float("nan")] + base[0][1:]), (303, [float("inf")] + base[0][1:])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS x", "'y' AS n", "0 AS component").repartition(7)
    _whiten_by_hand(rows, whiten(df).collect())
    other = spark.createDataFrame([(400, [1.0]), (401, [])], "vec_id long, embedding array<float>")
    assert whiten(df.select("vec_id", "embedding").unionByName(other)).filter("vec_id >= 400").count() == 0
    flat = [(i, [float(i % 5), 2.0, float(i % 5) * 2]) for i in range(30)]
    _whiten_by_hand(flat, whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect())
    for few in (df.limit(0), df.filter("vec_id = 5"), df.filter("vec_id = 300")):
        assert whiten(few).count() == 0


def test_whitening_of_the_given_table(spark):
    from webloom.llm.queries import op13_whitening
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    _whiten_by_hand(rows, op13_whitening(spark, SF001).collect())


# the labelled sample of the classifiers

def test_a_labelled_sample_is_bounded_where_ids_repeat(spark):
    from webloom.llm.linear import labelled_sample
    docs = spark.createDataFrame([(1, f"word{i} and more", i) for i in range(500)] + [(2, "two", 0), (None, "none", 0)],
                                 "doc_id long, text string, words int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    assert len(labelled_sample(docs, labels, ["toxic"], max_rows=10)) == 10
    every = labelled_sample(docs, labels, ["toxic"], max_rows=1000)
    assert len(every) == 501 and {y[0] for y, *_ in every} == {0, 1}
    assert labelled_sample(docs.limit(0), labels, ["toxic"]) == []
