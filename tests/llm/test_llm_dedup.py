"""SimHash, line, paragraph and substring dedup against plain loops, and components."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import SF_DIR
from pyspark.sql import functions as F

from patchlight.llm import components, linededup, paragraphs, simhash, substrings
from patchlight.llm.components import connected_components

from .conftest import documents, odd_rows, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Sets:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("few", [0, 12, 60, 100_000])
def test_components_match_union_find(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(500, 500 + k) for k in range(1, 80)] + [(900 + k, 890) for k in range(9)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(110)] + [(5, 5), (None, 3), (3, None), (7, 8)]
    sets = Sets()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            sets.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: sets.root(x) for x in sets.up}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    pairs = spark.createDataFrame(edges, "a bigint, b bigint").where("a is not null and b is not null")
    named = pairs.select(F.struct(F.col("a").alias("x"), F.lit(1).alias("y")).alias("a"), F.struct(F.col("b").alias("x"), F.lit(1).alias("y")).alias("b"))
    got = {r.node.x: r.component.x for r in connected_components(named).collect()}
    assert got == {x: sets.root(x) for x in sets.up}


def fingerprint(text):
    words = WORD.findall(low(text))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(rows):
    marks = [(i, fingerprint(t)) for i, t in rows]
    sets = Sets()
    for n, (_, a) in enumerate(marks):
        sets.root(n)
        for m in range(n):
            if (a ^ marks[m][1]).bit_count() <= 2:
                sets.join(n, m)
    least = {}
    for n, (i, _) in enumerate(marks):
        r = sets.root(n)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, f"{m:016x}", least[sets.root(n)]) for n, (i, m) in enumerate(marks)), key=repr)


def test_simhash_matches_all_pairs(spark, odd, none):
    rows = [(i, t) for i, t, *_ in odd_rows()]
    got = simhash.near_copies(odd).withColumn("fp", F.lpad(F.lower(F.hex("fp")), 16, "0"))
    assert sorted(map(tuple, got.collect()), key=repr) == simhash_groups(rows)
    assert simhash.near_copies(none).count() == 0 and simhash.one_of_each(none).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    want = [i for i, _, c in simhash_groups([r for r in rows if r[0] is not None]) if i == c]
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(want)
    assert kept.where("doc_id is null").count() == odd.where("doc_id is null").count()


def test_simhash_links_bits_at_the_radius(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(5)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(8)]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in base + near + [0, (1 << 64) - 1, 1 << 63]})
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp bigint"))
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in edges.collect())
    sets = Sets()
    for n, a in enumerate(values):
        for b in values[:n]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                sets.join(a, b)
    assert {r.node: r.component for r in connected_components(edges).collect()} == {x: sets.root(x) for x in sets.up}


@pytest.mark.parametrize("name", ["op9_simhash_near_dedup", "op10_substring_dedup", "op4_paragraph_dedup", "op7_line_dedup"])
def test_queries_cover_all_documents(spark, name):
    from patchlight.llm.catalog import QUERIES

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
    want = {"op9": lambda: simhash_groups(docs), "op10": lambda: substring_rows(docs), "op4": lambda: paragraph_rows(docs), "op7": lambda: line_rows(docs, shares(spark))}
    rows = QUERIES[name](spark, SF_DIR).collect()
    if name.startswith("op4"):
        check_passages(docs, [r for r in rows if r.word is not None])
        rows = [r[:5] for r in rows if r.word is None]
    got = [tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in rows]
    assert sorted(got, key=repr) == sorted(want[name.split("_")[0]](), key=repr)


def substring_rows(docs, length=100):
    seen, out = set(), []
    for i, t in docs:
        text = (t or "").encode()
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            part = text[p : p + length]
            if part in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(part)
        left = bytes(x for x, g in zip(text, gone) if not g)
        out.append((i, len(text), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return out


def test_substrings_of_odd_rows(spark, odd, none):
    got = {}
    for r in substrings.deduplicated(odd).collect():
        got.setdefault((r.doc_id, r.n_bytes), []).append(r)
    assert sum(map(len, got.values())) == odd.count()
    # Repeated rows are one document: none of them loses a byte to the other.
    plain = sorted({(i, t) for i, t, *_ in odd_rows() if i is not None}, key=lambda x: (x[0], substrings.tie_of((x[1] or "").encode())))
    want = {(r[0], r[1]): r for r in substring_rows(plain)}
    for key, rows in got.items():
        if key[0] is not None:
            assert {tuple(r) for r in rows} == {want[key]}
    assert substrings.deduplicated(none).count() == 0


def test_substrings_of_periodic_and_shifted_texts(spark):
    rng = random.Random(4)
    block = "".join(rng.choice("abcd") for _ in range(700))
    texts = ["a" * 400, "a" * 99, "ab" * 200, block, block[37:400], "x" + block[:99], block[100:200] * 5, "a" * 250 + block[:150], "é" * 90, "zé" * 120]
    rows = [(k * 7 % 11, t) for k, t in enumerate(texts)]
    got = sorted(map(tuple, substrings.deduplicated(documents(spark, [(*r, "en", "s") for r in rows])).collect()))
    assert got == sorted(substring_rows(sorted(rows)))


def test_substrings_of_a_gram_with_thousands_of_borders(spark, monkeypatch):
    """One passage with other bytes round it in each of many texts, as many rows, and in groups of few borders."""
    rng = random.Random(13)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    block = letters(70)
    rows = [(k, letters(rng.randrange(20, 60)) + block + letters(rng.choice([5, 40, 80]))) for k in range(2500)]
    rows += [(3000 + k, rows[37 * k][1][10:] + letters(3)) for k in range(60)]
    want = sorted(substring_rows(rows))
    assert sum(r[2] > 0 for r in want) > 50
    monkeypatch.setattr(substrings, "BORDERS", 300)
    got = substrings.deduplicated(documents(spark, [(*r, "en", "s") for r in rows]))
    assert sorted(map(tuple, got.collect())) == want


def test_borders_that_one_task_takes_make_no_rows_of_windows(spark, monkeypatch):
    rng = random.Random(16)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    block, shuffled, real = letters(70), [], substrings.repeats_by_window
    rows = [(k, letters(rng.randrange(20, 60)) + block + letters(rng.choice([5, 40, 80]))) for k in range(900)]
    rows += [(3000 + k, rows[13 * k][1][10:] + letters(3)) for k in range(60)]

    def counted(parts, length):
        shuffled.append(parts.count())
        return real(parts, length)

    monkeypatch.setattr(substrings, "repeats_by_window", counted)
    got = substrings.deduplicated(documents(spark, [(*r, "en", "s") for r in rows]))
    assert sorted(map(tuple, got.collect())) == sorted(substring_rows(rows))
    assert shuffled == [0]


def test_substring_pieces_agree_with_whole_texts(spark, monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh") for _ in range(3000))
    rows = [(1, text), (2, text[500:2500] + "q" + text[:300]), (3, "w" + text)]
    monkeypatch.setattr(substrings, "PIECE", 700)
    batches = documents(spark, [(*r, "en", "s") for r in rows]).select("doc_id", "text").toArrow().to_batches()
    places = {}
    for ids, _, at, texts in substrings.pieces(iter(batches), 100):
        s = substrings.Segments(texts)
        for k, p, n in zip(s.text, s.place, s.count):
            places.setdefault(int(ids[k]), []).extend(range(at[k] + p, at[k] + p + n))
    assert {k: sorted(v) for k, v in places.items()} == {i: list(range(len(t) - 99)) for i, t in rows}


def paragraph_rows(docs, least=20):
    found, sets = [], Sets()
    for i, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            words = WORD.findall(low(line))
            if len(words) >= least:
                found.append((i, k, len(words), frozenset(tuple(words[j : j + 5]) for j in range(len(words) - 4))))
    holders = {}
    for n, (*_, s) in enumerate(found):
        sets.root(n)
        for m, common in Counter(m for g in s for m in holders.get(g, ())).items():
            if common >= 0.8 * (len(s) + len(found[m][3]) - common):
                sets.join(n, m)
        for g in s:
            holders.setdefault(g, []).append(n)
    return [(*found[n][:3], *found[sets.root(n)][:2]) for n in range(len(found)) if sets.root(n) != n]


def test_paragraph_groups_of_many_near_copies(spark, odd, none):
    rng = random.Random(6)
    base = sentence(rng, 120).split()
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(1000)}"
        texts.append(sentence(rng, 3) + "\n" + " ".join(words))
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    got = sorted(map(tuple, paragraphs.repeated_paragraphs(documents(spark, rows)).collect()))
    assert got == sorted(paragraph_rows([r[:2] for r in rows]))
    assert paragraphs.repeated_paragraphs(none).count() == 0
    ids = {r.doc_id for r in paragraphs.repeated_paragraphs(odd).collect()}
    assert {5, 6} <= ids and not ids & {0, 1, 2, 3, 9, 10}


def test_groups_of_copies_that_are_not_all_alike(spark):
    """A large group in which most copies are not similar to any one of them: recall against all pairs, and no false link."""
    rng = random.Random(11)
    base = sentence(rng, 100).split()
    texts = []
    for _ in range(500):
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(40)}"
        texts.append(" ".join(words))
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    got = {(r.doc_id, r.line) for r in paragraphs.repeated_paragraphs(documents(spark, rows)).collect()}
    want = {r[:2] for r in paragraph_rows([r[:2] for r in rows])}
    assert got <= want and len(want) > 200
    assert len(got) >= 0.97 * len(want), (len(got), len(want))


def banded_rows(docs, settings):
    """(doc_id, line) of the later lines of groups that all similar pairs with a common band make."""
    ids, texts = [i for i, _ in docs], [t.encode() for _, t in docs]
    found = paragraphs.paragraphs_of(texts, settings.least_words)
    bands, rows = settings.bands()
    marks = paragraphs.signatures(found.shingles, found.begin, bands, rows)
    parts = [frozenset(x.tolist()) for x in np.split(found.shingles, found.begin[1:])]
    sets = Sets()
    for n, s in enumerate(parts):
        sets.root(n)
        for m in np.flatnonzero((marks[:n] == marks[n]).any(axis=1)).tolist():
            common = len(s & parts[m])
            if common >= settings.threshold * (len(s) + len(parts[m]) - common):
                sets.join(n, m)
    return {(ids[found.text_of[n]], int(found.line_no[n])) for n in range(len(parts)) if sets.root(n) != n}


@pytest.mark.parametrize("meet", [4096, 16])
def test_no_pair_with_a_common_band_is_left_out(spark, monkeypatch, meet):
    """Large buckets of copies that are not all alike, met in one task or block by block, against all their pairs."""
    monkeypatch.setattr(paragraphs, "MEET", meet)
    rng = random.Random(14)
    rows = []
    for k in range(3):
        base = sentence(rng, 100).split()
        for n in range(300):
            words = list(base)
            for _ in range(rng.randrange(1, 6)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(30)}"
            rows.append((1000 * k + n, " ".join(words), "en", "s"))
    settings = paragraphs.Settings(shape=(6, 2))
    got = {(r.doc_id, r.line) for r in paragraphs.repeated_paragraphs(documents(spark, rows), settings).collect()}
    want = banded_rows([r[:2] for r in rows], settings)
    assert got == want and len(want) > 100


@pytest.mark.parametrize("cells", [1 << 22, 400])
def test_links_among_sets_join_what_all_pairs_join(monkeypatch, cells):
    monkeypatch.setattr(paragraphs, "CELLS", cells)
    rng = np.random.default_rng(7)
    base = [rng.choice(300, 40, replace=False) for _ in range(5)]
    held = []
    for _ in range(120):
        own = base[rng.integers(5)]
        held.append(np.union1d(rng.choice(own, rng.integers(30, 41), replace=False), rng.choice(300, rng.integers(0, 6))))
    group = rng.integers(0, 90, len(held))
    want, got = Sets(), Sets()
    for sets in (want, got):
        for n, g in enumerate(group.tolist()):
            sets.join(f"g{g:03}", f"s{n:03}")
    for n, s in enumerate(held):
        for m in range(n):
            common = len(np.intersect1d(s, held[m]))
            if common >= 0.8 * (len(s) + len(held[m]) - common):
                want.join(f"s{n:03}", f"s{m:03}")
    for a, b in paragraphs.links_among(group, np.array([len(x) for x in held]), np.concatenate(held), 0.8):
        common = len(np.intersect1d(held[a], held[b]))
        assert common >= 0.8 * (len(held[a]) + len(held[b]) - common)
        got.join(f"s{a:03}", f"s{b:03}")
    assert [got.root(f"s{n:03}") for n in range(len(held))] == [want.root(f"s{n:03}") for n in range(len(held))]


def check_passages(docs, found, size=20, surely=51):
    """All words of a passage lie in windows that occur earlier, and every passage of ``surely`` words that occurs earlier has a part in one."""
    words, lines, grams = {}, {}, {}
    for k, text in sorted(docs):
        words[k] = WORD.findall(low(text))
        lines[k] = [(text or "")[: m.start()].count("\n") for m in WORD.finditer(text or "")]
        for at in range(len(words[k]) - size + 1):
            grams.setdefault(tuple(words[k][at : at + size]), (k, at))
    repeats = {k: [grams[tuple(own[at : at + size])] < (k, at) for at in range(len(own) - size + 1)] for k, own in words.items()}
    spans = {}
    for r in found:
        covered = {i for at in range(r.word, r.word + r.n_words - size + 1) if repeats[r.doc_id][at] for i in range(at, at + size)}
        assert covered >= set(range(r.word, r.word + r.n_words))
        assert words[r.doc_id][r.word : r.word + size] == words[r.kept_doc_id][r.kept_word : r.kept_word + size]
        assert (r.line, r.kept_line) == (lines[r.doc_id][r.word], lines[r.kept_doc_id][r.kept_word])
        assert (r.kept_doc_id, r.kept_word) < (r.doc_id, r.word)
        spans.setdefault(r.doc_id, set()).update(range(r.word, r.word + r.n_words))
    held = {}
    for k, own in words.items():
        for at in range(len(own) - surely + 1):
            if held.setdefault(tuple(own[at : at + surely]), (k, at)) != (k, at):
                assert spans.get(k, set()) & set(range(at, at + surely))


def test_passages_inside_longer_lines_are_found(spark, odd, none):
    rng = random.Random(12)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(4000)}"
    fill = lambda n: " ".join(word() for _ in range(n))
    passages = [fill(51), fill(60), fill(300)]
    rows, planted = [], {}
    for k in range(90):
        text = fill(rng.randrange(0, 200))
        if k % 3 == 0:
            n = k // 3 % 3
            text += rng.choice([" ", "\n"]) + passages[n].replace(" ", rng.choice(["  ", " ", "\n"])) + " " + fill(rng.randrange(0, 100))
            planted[k] = n
        rows.append((k, text, "en", "s"))
    rows.append((200, passages[0] + " " + fill(30) + " " + passages[0], "en", "s"))
    found = paragraphs.repeated_passages(documents(spark, rows, clashes=True)).collect()
    first = {n: min(k for k, m in planted.items() if m == n) for n in range(3)}
    later = {k for k, n in planted.items() if k != first[n]} | {200}
    assert {r.doc_id for r in found} == later
    check_passages([r[:2] for r in rows], found)
    assert sum(r.doc_id == 200 for r in found) == 2
    assert paragraphs.repeated_passages(none).count() == 0
    assert {5, 6, 11} <= {r.doc_id for r in paragraphs.repeated_passages(odd).collect()}


def similar_later(docs):
    """Ids that are not the least of their group, by all pairs of whole texts with a five-word Jaccard of 0.8."""
    found, sets, least = [], Sets(), {}
    for i, t in docs:
        words = WORD.findall(low(t))
        found.append((i, frozenset(tuple(words[j : j + 5]) for j in range(max(len(words) - 4, 1)))))
    for n, (_, s) in enumerate(found):
        sets.root(n)
        for m in range(n):
            common = len(s & found[m][1])
            if common >= 0.8 * (len(s) + len(found[m][1]) - common):
                sets.join(n, m)
    for n, (i, _) in enumerate(found):
        least[sets.root(n)] = min(least.get(sets.root(n), i), i)
    return {i for n, (i, _) in enumerate(found) if least[sets.root(n)] != i}


def test_near_dedup_stage_reaches_similarity(spark, odd, none):
    import corpus_pipeline as cp

    rng = random.Random(8)
    rows = []
    for k in range(12):
        words = sentence(rng, 150).split()
        for n in range(4):
            near = list(words)
            for j in range(n):
                near[10 + 40 * j] = f"edit{k}{n}{j}"
            rows.append((100 * n + k, "\n".join(" ".join(near[a : a + 30]) for a in range(0, 150, 30)), "en", "s"))
    rows += [(900 + k, sentence(rng, k), "en", "s") for k in range(1, 8)] + [(950, "alpha beta", "en", "s"), (951, "alpha  Beta", "en", "s"), (952, "alpha", "en", "s")]
    gone = similar_later([r[:2] for r in rows])
    assert len(gone) > 30
    kept = cp.near_dedup(spark, documents(spark, rows), SF_DIR).collect()
    assert {r.doc_id for r in kept} == {r[0] for r in rows} - gone
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    kept = cp.near_dedup(spark, odd, SF_DIR)
    assert {r.doc_id for r in kept.where("doc_id is not null").collect()} == {i for i, _ in docs if i is not None} - similar_later([d for d in docs if d[0] is not None])
    assert kept.where("doc_id is null").count() == 3 and cp.near_dedup(spark, none, SF_DIR).count() == 0


def test_near_dedup_stage_meets_by_fingerprints(spark, monkeypatch):
    """Near copies within the bits of the fingerprint method go, also if no band brings them together; texts that are not similar stay."""
    import corpus_pipeline as cp

    monkeypatch.setattr(paragraphs, "tune", lambda *_: (1, 128))
    rng = random.Random(15)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(3000)}"
    rows = []
    for k in range(40):
        words = [word() for _ in range(60)]
        rows += [(k, " ".join(words), "en", "s"), (1000 + k, " ".join([*words[:-1], "Other"]), "en", "s")]
    marks = {i: simhash.fingerprint(t.lower().encode().split(), 5) for i, t, *_ in rows}
    near = {1000 + k for k in range(40) if ((marks[k] ^ marks[1000 + k]) & (1 << 64) - 1).bit_count() <= 2}
    assert len(near) > 5
    gone = {r[0] for r in rows} - {r.doc_id for r in cp.near_dedup(spark, documents(spark, rows), SF_DIR).collect()}
    assert near <= gone <= similar_later([r[:2] for r in rows])


def test_bands_are_tuned_for_recall():
    for threshold in (0.6, 0.8, 0.9):
        bands, rows = paragraphs.tune(threshold, 0.9995)
        assert paragraphs.collision(threshold, bands, rows) >= 0.9995 and bands * rows <= 128


def shares(spark):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    key = linededup.order_key(F.col("doc_id"), F.col("text"))
    return {r.doc_id: r.share for r in table.select("doc_id", F.pmod(F.xxhash64(key), F.lit(linededup.Settings().firsts)).alias("share")).collect()}


def line_rows(docs, share):
    """Pairs and alignments by plain loops over the same rules; ``share`` is the hash class of a document."""
    settings = linededup.Settings()
    texts = {i: t for i, t in docs if t is not None and i is not None}
    lines = {i: t.split("\n") for i, t in texts.items()}
    count = lambda x: len(WORD.findall(x))
    holders, runs = {}, {}
    for i in sorted(lines):
        for x in {x for x in lines[i] if count(x) >= settings.anchor_words}:
            holders.setdefault(x, []).append(i)
        words = [count(x) for x in lines[i]]
        for a in range(len(words)):
            ahead = next((b for b in range(a + 1, len(words) + 1) if sum(words[a:b]) >= settings.block_words), None)
            back = next((b for b in range(a, -1, -1) if sum(words[b : a + 1]) >= settings.block_words), None)
            for run in ([] if ahead is None else [(a, ahead)]) + ([] if back is None else [(back, a + 1)]):
                own = runs.setdefault(tuple(lines[i][slice(*run)]), [])
                own += [i] * (i not in own)
    pairs = {(b, a) for h in holders.values() if len(h) <= settings.rare for n, b in enumerate(h) for a in h[:n]}
    for h in runs.values():
        firsts = {}
        for a in h:
            firsts.setdefault(share[a], a)
        pairs |= {(b, a) for b in h for a in firsts.values() if a < b}
    cut, earlier = {}, {}
    for b, a in pairs:
        places = linededup.common_blocks(lines[b], lines[a], [count(x) for x in lines[b]], settings.block_words)
        if places:
            cut.setdefault(b, set()).update(places)
            earlier.setdefault(b, set()).add(a)
    out = []
    for i, t in docs:
        gone = cut.get(i, ())
        left = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone)
        out.append((i, len((t or "").split("\n")), len(gone), tuple(sorted(earlier.get(i, ()))), hashlib.sha256(left.encode()).hexdigest()))
    return out


def test_patience_diff_aligns_in_order_and_finds_unique_lines():
    rng = random.Random(7)
    for _ in range(200):
        a = [rng.randrange(12) for _ in range(rng.randrange(0, 25))]
        b = [rng.randrange(12) for _ in range(rng.randrange(0, 25))]
        pairs = linededup.patience_matches(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert linededup.patience_matches([1, 2, 3, 9, 4], [7, 1, 2, 3, 4]) == [(0, 1), (1, 2), (2, 3), (4, 4)]
    assert linededup.common_blocks([1, 2, 3, 9, 4], [7, 1, 2, 3, 4], [5, 5, 5, 5, 5], 10) == [0, 1, 2]


def test_lines_of_odd_rows(spark, odd, none):
    out = linededup.deduplicated_documents(odd)
    assert out.columns == odd.columns and linededup.deduplicated_documents(none).count() == 0
    got = {(r.doc_id, r.key): r.text for r in out.where("doc_id in (0, 1, 3, 4)").collect()}
    assert out.where("doc_id = 4").count() == 4 and got[0, "k"] is None and got[1, "k"] == ""
    assert out.where("doc_id = 5").count() == 0  # all its lines are those of document 4
    assert out.where("doc_id is null").count() == 3
    assert out.where("doc_id = 11").first().text.startswith("x\ny\nx\ny ")


def test_runs_find_what_all_pairs_find(spark):
    """Frequent and short lines in blocks that start, end and are cut in all ways, against all pairs of documents without any cap.

    Blocks stand in one order here; where they stand in any order a few lines are lost (the README has the share on the tables).
    """
    rng = random.Random(14)
    common = [sentence(rng, rng.choice([1, 2, 3, 5, 6, 7, 12])) for _ in range(14)] + ["", "Licensed under the Apache License, Version 2.0."]
    rows = []
    for k in range(120):
        text = []
        for a in sorted(rng.sample(range(len(common)), rng.randrange(1, 4))):
            text += common[a : a + rng.randrange(1, 7)] + [sentence(rng, rng.randrange(3, 9)) + f" {k}"]
        rows.append((k, "\n".join(text), "en", "s"))
    got = {r.row.doc_id: set(r.places or ()) for r in linededup.deduplicated(documents(spark, rows)).collect()}
    docs = [r[:2] for r in rows]
    lines = {i: t.split("\n") for i, t in docs}
    words = {i: [len(WORD.findall(x)) for x in own] for i, own in lines.items()}
    want = {i: set() for i in lines}
    for b in lines:
        for a in lines:
            if a < b:
                want[b] |= set(linededup.common_blocks(lines[b], lines[a], words[b], 10))
    assert sum(map(len, want.values())) > 150
    lost = sum(len(want[i] - got[i]) for i in want)
    assert lost <= 0.05 * sum(map(len, want.values())) and all(got[i] <= want[i] for i in want), (lost, sum(map(len, want.values())))
