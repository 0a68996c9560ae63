"""Periodic runs, document fingerprints and conversation repair."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from patchlight.llm import fingerprints, periodic, repair
from patchlight.llm.catalog import QUERIES
from patchlight.session import written

from .conftest import documents, odd_rows, sentence

# Periodic runs


def plain_runs(words, least=6, periods=4):
    """All runs by trying every period at every place."""
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids, spans = np.array([names[w] for w in words], np.int64), {}
    for q in range(1, len(words) // periods + 1):
        same = np.concatenate(([False], ids[:-q] == ids[q:], [False]))
        ends = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for start, end in ends[ends[:, 1] - ends[:, 0] + q >= max(least, periods * q)].tolist():
            spans.setdefault((start, end - start + q), q)  # the smallest period comes first
    return sorted((s, length, q) for (s, length), q in spans.items())


def plain_row(doc_id, text, planted=True):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    collapsed = b" ".join(w for i, w in enumerate(words) if i not in gone)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest(), n)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("least, periods", [(6, 4), (4, 2), (2, 2), (9, 3)])
def test_runs_of_random_words(least, periods):
    rng = random.Random(least)
    texts = []
    for _ in range(120):
        text = [rng.choice("ab" if rng.random() < 0.5 else "abc") for _ in range(rng.randrange(0, 40))]
        if text and rng.random() < 0.5:
            text += text[-rng.randrange(1, len(text) + 1) :] * rng.randrange(1, 7)
        texts.append(text)
    texts.append(["a"] * 5000)
    texts.append((["a", "b"] * 3 + ["c"]) * 300)
    ids, want, base = [], [], 0
    for k, text in enumerate(texts):
        ids += [hash((k, w)) for w in text] + [-k - 1]
        if len(text) < 1000:
            want += [(base + s, length, q) for s, length, q in sorted(plain_runs(text, least, periods), key=lambda r: (r[0], r[2]))]
        base += len(text) + 1
    ids = np.unique(np.array(ids), return_inverse=True)[1]
    got = periodic.runs_of(ids, least, periods)
    last = len(ids) - 2101
    assert [r for r in got if r[0] < last - 5001] == want
    assert [r for r in got if last - 5001 <= r[0] < last] == [(last - 5001, 5000, 1)]
    tail = [r for r in got if r[0] >= last]
    assert (last, 2100, 7) in tail


def test_periodic_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    got = rows_of(QUERIES["op13_periodic_runs"](spark, SF_DIR))
    assert got == sorted((plain_row(d.doc_id, d.text) for d in docs), key=repr)
    assert sum(r[1] > 0 for r in got) > 5


def test_periodic_runs_of_odd_rows(spark, odd, none):
    assert periodic.with_runs(none).count() == 0
    rows = odd_rows() + [(None, "a b " * 9, None, None), (7, "x " * 4000, None, None), (8, "one " + "a b c " * 5 + "a b two two two two two two", None, None)]
    found = periodic.with_runs(documents(spark, rows, clashes=True)).collect()
    assert len(found) == len(rows)
    got = sorted((repr(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found)
    want = []
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        want.append((repr(doc_id), len(words), runs, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    assert got == sorted(want)


# Fingerprints


def plain_sketch(text, shingle=5, share=0.25):
    words = (text or "").encode().split()
    if not words:
        return []
    found = {hashlib.md5(b" ".join(words[i : i + shingle])).hexdigest() for i in range(max(1, len(words) - shingle + 1))}
    return sorted({int(h[:15], 16) for h in found if int(h[0], 16) < 16 * share} or {int(min(found)[:15], 16)})


def plain_likeness(a, b):
    return len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0


def test_fingerprints_of_odd_rows_in_small_ranges(spark, odd, none):
    assert fingerprints.with_edited(none).count() == 0
    rng = random.Random(5)
    rows = odd_rows() + [(7, sentence(rng, rng.randrange(30)), None, None) for _ in range(120)] + [(None, sentence(rng, 3), None, None) for _ in range(60)]
    docs = documents(spark, rows, clashes=True)
    tie = {r.text or "": r.h for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]), reverse=True)
    want = []
    for (doc_id, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        k = len(text) // 3
        want.append((repr(doc_id), text, len(text), plain_sketch(text), text[: len(text) - k] + after[:k], plain_sketch(after)))
    for bucket in (7, 1000):
        got = [(repr(r.doc_id), *r[1:]) for r in fingerprints.with_edited(docs, bucket).collect()]
        assert sorted(got) == sorted(want)
    alone = fingerprints.with_edited(documents(spark, [(1, "abcdef", None, None)])).collect()
    assert [r.edited for r in alone] == ["abcdab"]


def test_ranges_hold_their_share_of_a_key_with_a_third_of_all_rows(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(5)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id"))
    hot = spark.range(3000).select(key.alias("k"), F.xxhash64("id").alias("tie"), "id")
    seen = fingerprints.with_next(hot, "k", "tie", ["k", "tie", "id"], 100)
    rows = seen.select("k", "tie", "next.k", "next.tie", "next.id").collect()
    assert len(rows) == 3000 and len({r[4] for r in rows}) == 3000
    order = lambda k, tie: (k is not None, k or 0, tie)
    assert sum(order(r[2], r[3]) > order(r[0], r[1]) for r in rows) == 1
    text = seen._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "Python" not in text and "Arrow" not in text
    sizes = seen.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in sizes) < 1000


def test_sketches_merge_and_tell_containment_of_unequal_texts(spark):
    rng = random.Random(6)
    long, other = sentence(rng, 4000), sentence(rng, 60)
    part = " ".join(long.split()[1000:1200])
    row = spark.createDataFrame([(long, part, other)], "long string, part string, other string").select(
        *[fingerprints.sketch(F.col(c)).alias(c) for c in ("long", "part", "other")]
    )
    got = row.select(
        fingerprints.containment(F.col("part"), F.col("long")).alias("inside"), fingerprints.containment(F.col("other"), F.col("long")).alias("outside"),
        fingerprints.likeness(F.col("part"), F.col("long")).alias("like"), fingerprints.merged(F.col("part"), F.col("other")).alias("both"),
    ).first()
    assert got.inside == 1.0 and got.outside < 0.2 and got.like < 0.1
    assert got.both == sorted({*plain_sketch(part), *plain_sketch(other)})
    tiny = spark.createDataFrame([("a b", "c d")], "x string, y string").select(*[fingerprints.sketch(F.col(c)).alias(c) for c in "xy"])
    merged = tiny.select(fingerprints.merged(F.col("x"), F.col("y"))).first()[0]
    both = sorted(plain_sketch("a b") + plain_sketch("c d"))
    assert merged == ([h for h in both if h < 1 << 58] or both[:1])
    with pytest.raises(ValueError):
        fingerprints.sketch(F.col("x"), share=0.01)


def test_likeness_of_edited_documents(spark):
    rows = QUERIES["op12_document_fingerprints"](spark, SF_DIR).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    long = [r for r in rows if len(docs[r.doc_id].split()) >= 60]
    assert all(r.near_edited > r.near_next for r in long) and np.mean([r.near_next for r in long]) < 0.05
    assert abs(np.mean([r.near_edited for r in long]) - 0.5) < 0.06
    same = {}
    for r in rows:
        assert same.setdefault(docs[r.doc_id], r.fingerprint) == r.fingerprint


# Conversation repair

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def plain_repair(rows):
    """(cost, audit, lines) by trying all edits with up to two insertions in each gap."""
    best = None

    def go(i, state, cost, audit, lines, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and state in (0, 3):
            best = min(best, (cost, audit, lines)) if best else (cost, audit, lines)
        role = "assistant" if state == 2 else "user"
        if inserted < 2:
            go(i, NEXT[state, role[0]], cost + 5, audit + "I", [*lines, f"{role}:"], inserted + 1)
        if i == len(rows):
            return
        own, text, fault = rows[i]
        go(i + 1, state, cost + 2, audit + "D", lines, 0)
        if fault in ("blank", "duplicate"):
            return
        extra = 5 * (fault == "truncated")
        if (state, own[:1]) in NEXT:
            go(i + 1, NEXT[state, own[:1]], cost + extra, audit + "K", [*lines, f"{own}:{text}"], 0)
        go(i + 1, NEXT[state, role[0]], cost + extra + 1, audit + "R", [*lines, f"{role}:{text}"], 0)

    go(0, 0, 0, "", [], 0)
    return best


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        stripped = text.encode().strip().decode()
        fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain_conversations(rows):
    """Result rows of the query for (conv_id, turn, role, text) rows."""
    held = {}
    for conv, turn, role, text in rows:
        mine = held.setdefault(conv, [])
        word = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, mine in held.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in mine if t is not None]
        faults = plain_faults(mine)
        names = [f for _, _, f in faults]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, lines = plain_repair(faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, names.count("blank"), names.count("duplicate"), names.count("truncated"), illegal, cost, audit, digest, len(mine)))
    return sorted(out, key=repr)


def test_least_integers_are_the_cheapest_edits():
    rng = random.Random(8)
    for _ in range(250):
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), "t", rng.choice([None, None, *repair.FAULTS])) for _ in range(rng.randrange(6))]
        codes = [("sua".find(r[0]) % 4 if r else 3) + 4 * repair.FAULTS.index(f) for r, _, f in rows]
        cost, audit, lines = plain_repair(rows)
        for block in (1, 2, 3, 256):
            assert repair.solve(codes, block) == (cost, audit)
        steps = "".join(repair.steps_of(codes, audit))
        assert len(steps) == len(lines)
    codes = [rng.choice([0, 1, 1, 2, 2, 3, 5, 10, 13, 14]) for _ in range(3000)]
    assert repair.solve(codes, 256) == repair.solve(codes, 37) == repair.solve(codes, 3000)


def test_repair_query_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op11_conversation_repair"](spark, SF_DIR)) == plain_conversations(rows)


def test_repair_of_odd_conversations(spark, tmp_path):
    rng = random.Random(9)
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["Yes.", "No!", "cut", " \t", "", None, "x" * 40000 + ".", "Yes. \x0b"]
    rows = [(conv, rng.choice([None, 1, 2, 3, 4, 9]), rng.choice(roles), rng.choice(texts)) for conv in [*range(60), None] for _ in range(rng.randrange(1, 7))]
    rows += [(500, k, "user", "Yes.") for k in range(6)] + [(501, 1, "assistant", "No!")] * 3
    dropped = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "gone")]
    kinds = "conv_id bigint, turn bigint, role string, text string"
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{kinds}, pos int, fault string").repartition(3)
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = rows_of(QUERIES["op11_conversation_repair"](spark, str(tmp_path)))
    assert got == plain_conversations(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), 0) in got
    empty = tmp_path / "empty"
    spark.createDataFrame([], kinds).write.parquet(f"{empty}/conversations.parquet")
    assert rows_of(QUERIES["op11_conversation_repair"](spark, str(empty))) == []


def test_repair_does_not_depend_on_pieces(spark):
    rng = random.Random(10)
    rows = [(rng.randrange(3), k, rng.choice(["system", "user", "assistant"]), f"{rng.randrange(300)}{rng.choice(['.', '', '?'])}") for k in range(600)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = []
    for piece, block in ((4096, 256), (5, 3), (64, 1000)):
        faults = written(repair.with_faults(table, piece), "faults")
        made = written(repair.edits(faults, block), "edits")
        lines = repair.repaired(faults, made).orderBy("conv_id", "pos", "part").select("conv_id", "role", "text").collect()
        found.append((rows_of(made.drop("steps")), [tuple(r) for r in lines]))
    assert found[0] == found[1] == found[2]
