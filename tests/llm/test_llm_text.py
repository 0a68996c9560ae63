"""Mixing, chat, licences, decontamination, scoring, quality and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from patchlight.llm import chat, decontaminate, gru, licenses, lmscore, mixing, quality
from patchlight.llm import texts as tx
from patchlight.llm.catalog import ORACLES, QUERIES

from .conftest import documents, odd_rows, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    import check

    verdict, count = check.difference(spark, check.database(SF_DIR), SF_DIR, QUERIES[name], ORACLES[name])
    assert verdict == "ok" and count > 0


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == [*range(1, 14)] and "pipeline" in QUERIES


# Mixing


def counted(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("ab") if k % 7 else None, rng.choice("xyz"), rng.randrange(0, 50)) for k in range(300)] + [(None, "a", "x", 10), (None, "a", "x", 10)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_tokens bigint")


def test_raked_mass_meets_all_marginals(spark):
    source = {"a": 0.5, "b": 0.2, None: 0.3}
    lang = {"x": 0.6, "y": 0.3, "z": 0.1, "never": 0.4}
    targets = {
        "source": spark.createDataFrame(list(source.items()), "source string, share double"),
        "lang": spark.createDataFrame(list(lang.items()), "lang string, share double"),
    }
    table = counted(spark)
    cells = mixing.rake(mixing.cells_of(table, ["source", "lang"]), targets).collect()
    assert math.isclose(sum(c.mass for c in cells), 1.0, abs_tol=1e-6)
    for name, shares in (("source", source), ("lang", {k: v for k, v in lang.items() if k != "never"})):
        for value, share in shares.items():
            assert math.isclose(sum(c.mass for c in cells if c[name] == value), share / sum(shares.values()), abs_tol=1e-6)
    out = mixing.mixed(table.withColumn("sampled", F.lit("old")), targets, 3, 0.5).collect()
    assert len(out) == 302 and all(0 <= r.probability <= 1 for r in out)
    expected = sum(r.probability * r.n_tokens for r in out)
    assert math.isclose(expected, 0.5 * sum(r.n_tokens for r in out), rel_tol=1e-3)
    for r in out:
        digest = hashlib.md5(f"3:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        assert r.sampled == (int(digest[:13], 16) / 16**13 < r.probability)
    assert len({r.sampled for r in out if r.doc_id is None}) == 1


def test_mixing_of_odd_and_no_rows(spark, odd, none):
    assert mixing.mixed_documents(none).count() == 0 and mixing.sampled_documents(none).count() == 0
    assert mixing.mixed_documents(odd).count() == odd.count()
    kept = mixing.sampled_documents(odd)
    assert kept.columns == odd.columns
    drawn = {r.doc_id for r in mixing.mixed_documents(odd).where("sampled").collect()}
    assert {r.doc_id for r in kept.collect()} == drawn


# Chat


def nodes(spark, rows):
    return spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, score double, role string, text string, rank int, depth string")


def paths(rows):
    """Best path of each tree by walking up from every leaf."""
    out = {}
    for tree in {r[0] for r in rows}:
        mine = {r[1]: r for r in rows if r[0] == tree}
        inner = {r[2] for r in mine.values()}
        best = None
        for leaf in mine:
            if leaf in inner:
                continue
            path, at, seen = [], leaf, set()
            while at in mine and at not in seen:
                seen.add(at)
                path.append(at)
                at = mine[at][2]
            if at in seen:
                continue
            rank = (-sum(mine[n][3] or 0 for n in path) / len(path), -len(path), leaf)
            best = min(best, (rank, path[::-1])) if best else (rank, path[::-1])
        if best:
            out[tree] = [(mine[n][4] or "", mine[n][5] or "") for n in best[1]]
    return out


def test_trees_are_cut_to_their_best_path_and_read_back(spark):
    rng = random.Random(2)
    odd_texts = ["", "<|im_end|>", "<\\|im_start|>\\", "<<\\\\||>", "a\n<|im_start|>user\nb", "<", "|", "\\", "<n|", "é<|\U0001f600"]
    rows = []
    for tree in range(12):
        for node in range(rng.randrange(1, 40)):
            parent = rng.randrange(node) if node else rng.choice([None, 999])
            role = rng.choice(["user", "assistant", "assistant", "a\nb", "<n|", "<\\n|<|", None])
            text = rng.choice([*odd_texts, sentence(rng, 3), None])
            rows.append((tree, node, parent, rng.choice([None, 0.5, 1.0, 1.0, 2.0]), role, text, 1, "x"))
    rows += [(50, k, k - 1 if k else None, 1.0, "user", f"t{k}", 1, "x") for k in range(70)]  # a long chain
    rows += [(60, k, 0 if k else None, 1.0, "assistant", f"t{k}", 1, "x") for k in range(300)]  # a star of ties
    rows += [(70, 0, 1, 1.0, "user", "loop", 1, "x"), (70, 1, 0, 1.0, "user", "loop", 1, "x"), (70, 2, 1, 1.0, "user", "below", 1, "x")]
    back = chat.read_back(chat.format_trees(nodes(spark, rows))).collect()
    want = paths(rows)
    assert {r.tree: [tuple(t) for t in r.turns] for r in back} == want and 70 not in want
    for r in back:
        assert r.learned == "".join(t for role, t in want[r.tree] if role == "assistant")
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|") / 2 == len(want[r.tree])
    assert chat.format_trees(nodes(spark, [])).count() == 0


def test_conversations_with_nulls_ties_and_repeated_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (None, 1, "assistant", "b"), (None, 0, "user", "a"), (2, None, "assistant", "")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    back = {r.tree: [tuple(t) for t in r.turns] for r in chat.read_back(chat.format_trees(chat.chains(table))).collect()}
    assert back == {1: [("user", ""), ("user", ""), ("", "x")], None: [("user", "a"), ("assistant", "b")], 2: [("assistant", "")]}


# Licences


def test_licences_come_from_lines_or_the_nearest_folder(spark):
    rows = [
        (1, "/a/x.py", "code\nReleased under the MIT License.\nmore"), (2, "/a/b/c/y.py", "nothing"), (3, "/a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (4, "/a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), (5, "/z.py", None), (6, None, "x"), (7, "/ab/z.py", ""),
        (8, "/a/d/README", "the license of this is not known to anybody here at all"), (8, "/a/d/README", "the license of this is not known to anybody here at all"),
    ]
    table = spark.createDataFrame(rows, "doc_id bigint, path string, text string").withColumn("licence", F.lit(1)).withColumn("line", F.lit(2))
    got = sorted(((r.doc_id, r.own_licence, r.licence, r.licence_folder) for r in licenses.licensed(table).collect()), key=repr)
    assert got == [
        (1, "MIT", "MIT", None), (2, None, "GPL-3.0", "/a/b"), (3, "Apache-2.0", "Apache-2.0", None), (4, "GPL-3.0", "GPL-3.0", None), (5, None, None, None),
        (6, None, None, None), (7, None, None, None), (8, None, "Apache-2.0", "/a"), (8, None, "Apache-2.0", "/a"),
    ]
    assert licenses.licensed(table.limit(0)).count() == 0


def test_licence_plan_has_no_python(spark):
    plan = licenses.licensed(licenses.document_files(spark.read.parquet(f"{SF_DIR}/documents.parquet")))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


# Decontamination


def edit(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        chars[at : at + 1] = rng.choice([[], ["q"], ["q", chars[at]]])
    return "".join(chars)


def distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bands_find_what_full_alignment_finds():
    rng = random.Random(3)
    items = {decontaminate.normal(sentence(rng, n)): [n] for n in (3, 12, 20, 40)} | {"short": [0]}
    index = decontaminate.build_index(items)
    for _ in range(60):
        text = decontaminate.normal(" ".join([sentence(rng, 20), edit(rng, rng.choice(index.texts), rng.randrange(0, 14)), sentence(rng, 20)]))
        want = {}
        for k, item in enumerate(index.texts):
            if len(item) < index.q:
                if f" {item} " in f" {text} ":
                    want[k] = 0
            elif (d := distance_in(item, text)) <= index.edits[k]:
                want[k] = d
        assert {k: d for k, d, _ in decontaminate.matches(index, text)} == want


def test_leaks_of_odd_rows_in_blocks(spark, odd, none):
    rng = random.Random(4)
    long = next(r[1] for r in odd_rows() if r[0] == 3)
    items = [(1, long[5000:5300]), (2, long[5000:5300].upper()), (3, None), (4, ""), (5, "***"), (6, sentence(rng, 30)), (6, long[9000:9200]), (None, "one")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("x"))
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(odd, bench, block_chars=300).collect()), key=repr)
    assert got == sorted([(3, 1), (3, 2), (3, 6), (9, None), (10, None)], key=repr)
    kept = decontaminate.clean_documents(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(odd, bench.limit(0)).count() == 0


def test_every_planted_item_is_found(spark):
    docs = [(r.doc_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    items = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    want = {(i, k) for i, t in docs for k, x in items if x in t}
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op5_benchmark_decontamination"](spark, SF_DIR).collect()}
    assert want == {k for k, d in got.items() if d == 0}


# Language-model scores


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    shape = gru.Shape(3, 3, 4, 5)
    weights = {k: v.astype(float) + 0.1 * rng.standard_normal(v.shape) for k, v in gru.start(shape, np.arange(9)).items()}
    texts = [rng.integers(0, 9, n).astype(np.int32) for n in (7, 5, 3)]
    learner = gru.Learner(weights, rate=0.0)
    learner.squares = {k: np.full_like(v, 1e-30) for k, v in weights.items()}
    learner.learn(texts, steps=50, most=2)
    for name, values in weights.items():
        at = tuple(int(rng.integers(0, n)) for n in values.shape)
        ends = []
        for step in (1e-4, -1e-4):
            moved = {k: v.copy() for k, v in weights.items()}
            moved[name][at] += step
            ends.append(-gru.score(moved, texts, steps=50, most=2).sum() / 15)
        norm = math.sqrt(sum(v.sum() for v in learner.squares.values()))
        assert norm < 1.0  # nothing was clipped
        assert math.isclose(abs(ends[0] - ends[1]) / 2e-4, math.sqrt(learner.squares[name][at]), rel_tol=0.15, abs_tol=2e-4)


def test_scores_do_not_depend_on_windows_or_streams():
    rng = np.random.default_rng(1)
    weights = {k: (v + 0.3 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in gru.start(gru.Shape(), np.ones(1024)).items()}
    texts = [np.append(rng.integers(1, 1024, n), 0).astype(np.int32) for n in (0, 1, 5, 70, 300)]
    whole = gru.score(weights, texts, steps=1000, most=1)
    for steps, most in ((7, 1), (32, 3), (1, 5)):
        assert np.allclose(gru.score(weights, texts, steps, most), whole, rtol=1e-4)
    one = [np.array([w], np.int32) for w in range(1024)]
    assert math.isclose(np.exp(gru.score(weights, one)).sum(), 1.0, rel_tol=1e-4)


def test_streams_keep_the_order_of_texts_and_stay_even():
    sizes = [3, 90, 5, 40, 7, 60, 2, 80, 4, 30]
    streams = gru.streams_of([np.full(n, k + 1, np.int32) for k, n in enumerate(sizes)], 4)
    assert streams.words.shape == (max(streams.words.shape[0], 90), 3)
    begun = [streams.text[:, k][streams.first[:, k]].tolist() for k in range(3)]
    assert begun == [sorted(b) for b in begun] and sorted(sum(begun, [])) == list(range(10))
    for k, n in enumerate(sizes):
        assert (streams.text[streams.words >= 0] == k).sum() == n


def test_a_long_text_does_not_leave_few_streams(monkeypatch):
    rng, calls, step = np.random.default_rng(2), [], gru.Learner._window
    monkeypatch.setattr(gru.Learner, "_window", lambda self, *given: calls.append(given[0].size) or step(self, *given))
    learner = gru.Learner(gru.start(gru.Shape(2, 4, 4, 4), np.ones(8)))
    learner.learn([rng.integers(0, 8, n).astype(np.int32) for n in (20_000, *[100] * 60)])
    assert learner.seen == 26_000 and len(calls) < 300


def test_words_of_many_texts_at_once():
    texts = [None, b"", b" \n\t\x0b", b"A b  zz", "\u00c9 A\fb\u0085\u00a0 ".encode(), b"b\r\nzz\x00"]
    words = {b"\n": 0, b"a": 2, b"b": 3}
    ids, stops, places, distinct = lmscore.numbers(texts, words)
    assert len(stops) == len(texts)
    for text, own, at in zip(texts, np.split(ids, stops[:-1]), np.split(places, stops[:-1]), strict=True):
        found = [*tx.lowered(text or b"").split(), b"\n"]
        assert [distinct[k] for k in at] == found and own.tolist() == [words.get(w, -1) for w in found]


def test_base_scores_and_held_out_gain(spark):
    folder = SF_DIR.replace("0.001", "0.01")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    words = {i: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)), "\n"] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total, whole = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    got = {r.doc_id: r for r in QUERIES["op6_lm_score"](spark, folder).collect()}
    gain = 0.0
    for i, ws in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / whole) for w in ws), rel_tol=1e-9)
        gain += (r.score - r.base_score) * held[i]
    assert gain > 0


def test_rounds_learn_from_all_training_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "a b c") for k in range(400)], "doc_id bigint, text string")
    settings = lmscore.Settings(shape=gru.Shape(2, 4, 4, 4))
    lex = lmscore.lexicon(lmscore.word_counts(docs, settings), settings)
    seen = []
    # The last value is the number of words learnt from, summed over the tasks.
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: [seen.append(r) or r for r in collect(self)])
    lmscore.trained(docs, lex, settings)
    size = sum(v.size for v in lmscore.first_weights(lex, settings.shape).values())
    total = sum(r["row"][size - r["i"]] for r in seen if r["i"] <= size < r["i"] + len(r["row"]))
    assert total == lex.total == 4 * sum(lmscore.fold(k, 10) > 0 for k in range(400))


def test_rare_words_meet_their_counts_and_odd_rows_are_scored(spark, odd, none):
    small = lmscore.Settings(common=5, rounds=(0.5,), shape=gru.Shape(2, 4, 4, 4))
    wide = lmscore.Settings(rounds=(0.5,))
    a, b = ({(r.doc_id, r.n_tokens, round(r.base_score, 6), r.n_known) for r in lmscore.scored(odd, s).collect()} for s in (small, wide))
    assert a == b
    rows = lmscore.scored(odd, small).collect()
    assert len(rows) == odd.count() and all(r.held_out for r in rows if r.doc_id is None) and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert lmscore.scored(none, small).count() == 0


# Quality


def plain_counts(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_of_odd_rows(odd, none):
    texts = [r[1] for r in odd_rows()] + ["a b c d e f g h " * 3, "x\n x\nx\nx\n\n\n", "<|>&%$*#", "  é ü"]
    got = quality.counts([t if t is None else t.encode() for t in texts])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert list(zip(*(got[n].tolist() for n in names))) == [plain_counts(t or "") for t in texts]
    rows = quality.judged(odd, {"good": None, "toxic": None}).collect()
    assert len(rows) == odd.count() and all(r.kept != r.base_failed and r.good_probability is None for r in rows)
    assert quality.judged(none, {}).count() == 0 and quality.kept_documents(none, {}).count() == 0


def test_quality_query_counts_like_plain_loops(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op8_quality_rules"](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        rules = quality.Rules()
        judged = r.good_probability >= rules.least_good and r.toxic_probability < rules.most_toxic
        assert r.kept == (not r.base_failed and judged)
    assert 0.3 < sum(r.kept for r in rows) / len(rows) < 0.95


def test_judges_on_held_out_rows(spark):
    folder = SF_DIR.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    learn, hold = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    rows = quality.judged(docs.join(hold, "doc_id", "left_semi"), quality.fit_judges(docs, learn)).join(hold, "doc_id").where("not base_failed").collect()
    good = [r.good_probability >= 0.5 for r in rows if r.quality == 1], [r.good_probability >= 0.5 for r in rows if r.quality == 0]
    toxic = [r.toxic_probability >= 0.4 for r in rows if r.toxic == 1], [r.toxic_probability >= 0.4 for r in rows if r.toxic == 0]
    assert np.mean(good[0]) > 0.99 and np.mean(good[1]) < 0.05 and np.mean(toxic[0]) > 0.9 and np.mean(toxic[1]) < 0.01


def test_fit_is_whole_and_holds_little_at_a_time():
    fit = quality.Fit()
    assert (fit.rows, fit.most_features, quality.Rules().most_toxic) == (3000, 1024, 0.4)
    texts = [b"word " * 20000] * 6 + [None, b""] + [b"a b"] * 120
    parts = list(quality.chunks(texts))
    starts = [a for a, _ in parts] + [len(texts)]
    assert starts[0] == 0 and all(a < b for a, b in zip(starts, starts[1:]))
    assert all(b - a == 1 or sum(len(t or b"") for t in texts[a:b]) <= 1 << 18 for a, b in zip(starts, starts[1:]))
    assert [len(w.text_of) for _, w in parts[:2]] == [2 * -(-20000 // quality.WINDOW)] * 2


def test_fit_without_or_with_one_sided_labels(spark, odd):
    kind = "doc_id bigint, quality int, toxic int"
    assert set(quality.fit_judges(odd, spark.createDataFrame([], kind)).values()) == {None}
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, None), (None, 1, 0), (100, 1, 0)], kind)
    assert set(quality.fit_judges(odd, labels).values()) == {None}


# Shared helpers and the pipeline


def test_words_of_batches():
    texts = [None, b"", b" a  b\tc\n", "é x y".encode(), b"z"]
    pages = tx.Pages(texts)
    starts, ends, owner = pages.words()
    words = [(int(k), bytes(pages.buffer[a:b])) for a, b, k in zip(starts, ends, owner)]
    assert words == [(k, w.encode()) for k, t in enumerate(texts) for w in WORD.findall((t or b"").decode())]
    sums = pages.prefix_sums()
    again = tx.Pages([b"qq a  b"]).prefix_sums()
    assert sums.spans(starts[:1], ends[:1]) == again.spans(np.array([3]), np.array([4]))


def test_pipeline_stages(spark, odd, none):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in cp.STAGES:
        out = stage(spark, docs, SF_DIR)
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert 0 < out.count() <= docs.count()
        docs = spark.createDataFrame(out.collect(), docs.schema)
        for rows in (odd, none) if stage is not cp.mixing_to_weights else ():
            made = stage(spark, rows, SF_DIR)
            assert made.columns == rows.columns and made.count() <= rows.count()
    assert sorted(r.doc_id for r in cp.run(spark, SF_DIR).collect()) == sorted(r.doc_id for r in docs.collect())
    assert set(docs.columns) == set(documents(spark, []).columns)
