"""Fill-in-middle, vector codes and quality rules against brute force, their oracles, and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, same
from tidemark.llm import quality_rules
from tidemark.llm.fill_middle import DELIMITER, ESCAPE, count_units, fill_in_middle, mark_units, restore, unmark
from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.llm.quality_rules import apply_rules
from tidemark.llm.vector_codes import compress_vectors
from tidemark.sources import table

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_vector_codes"])
def test_against_sql(spark, data, name):
    same(QUERIES[name](spark, data), connect(data), ORACLES[name])


# Fill in middle


def by_hand(doc_id, text):
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(5)
    alphabet = [DELIMITER, ESCAPE, "u", "e", "<", "P", ">", "S", "M", "\n", "\r", " ", "\x00", "$", "\\", "é", "é", "😀", "👩‍💻", " "]
    return ["", "a", "<P>", "x<S>y", "<M", "<<", DELIMITER, ESCAPE, ESCAPE + DELIMITER, ESCAPE + "u", "$0", *("".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(400))]


def test_fill_in_middle_of_odd_texts(spark):
    rows = [(k, t, None, None, None, "x") for k, t in enumerate(odd_texts())]
    rows += [(None, "no id at all", None, None, None, None), (900, None, None, None, None, None), (7, "again", None, None, None, None), (7, "again", None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("extra", "form").withColumn("marked", F.lit(1)).withColumn("n", F.lit(2))
    out = fill_in_middle(docs)
    got = collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect())
    assert got == collections.Counter((i, *by_hand(i, t or "")) for i, t, *_ in rows)
    back = out.select("doc_id", restore(F.col("output"), F.col("form")).alias("t")).collect()
    assert collections.Counter((r.doc_id, r.t) for r in back) == collections.Counter((i, t or "") for i, t, *_ in rows)
    assert {r.form for r in out.collect()} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_a_very_long_text(spark):
    text = "añ😀\n" * 400_000
    ids = [i for i in range(60) if by_hand(i, "xyz")[1] != "plain"][:2]
    docs = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
    out = fill_in_middle(docs)
    assert [r[0] for r in out.orderBy("doc_id").select(F.sha2("output", 256)).collect()] == [hashlib.sha256(by_hand(i, text)[4].encode()).hexdigest() for i in sorted(ids)]
    assert out.filter(restore(F.col("output"), F.col("form")) == F.lit(text)).count() == 2


def test_marks_come_off_again(spark):
    rows = spark.createDataFrame([(t,) for t in odd_texts()], "t string").withColumn("m", mark_units(F.col("t")))
    assert rows.filter((unmark(F.col("m")) != F.col("t")) | (count_units(F.col("m")) != F.char_length("t"))).count() == 0


def test_fill_in_middle_of_nothing(spark):
    assert fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0


# Vector codes


def lloyd(rows, parts=4, entries=256, rounds=4):
    """Plain Lloyd's rounds with Python's integers: {row: (codes, error)}, entries."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max([len(v) for _, v, _ in kept] or [0])
    part = max(1, -(-width // parts))
    whole = [[math.floor(1024 * x) for x in v] + [0] * (parts * part - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, whole[k]))[:entries]
    cut = lambda v, p: v[p * part : (p + 1) * part]
    books = [[cut(whole[k], p) for k in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for turn in range(rounds + 1):
        codes = [[near(v, p) for p in range(parts)] for v in whole]
        if turn < rounds:
            new = [list(b) for b in books]
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [cut(v, p) for v, c in zip(whole, codes, strict=True) if c[p] == e]
                    if mine:
                        new[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
            books = new
    errors = [sum(far(cut(v, p), books[p][c[p]]) for p in range(parts)) for v, c in zip(whole, codes, strict=True)]
    labels = collections.Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] += e
    found = collections.Counter((i, bytes(c), e, labels[label]) for (i, _, label), c, e in zip(kept, codes, errors, strict=True))
    return found, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<double>, label int, codes int"


def check(spark, rows, **settings):
    frame = spark.createDataFrame([(*r, 1) for r in rows], VECTORS).repartition(3)
    out, books = compress_vectors(frame, **settings)
    want, digest = lloyd(rows, **{k: v for k, v in settings.items() if k in ("parts", "entries", "rounds")})
    assert collections.Counter((r.vec_id, bytes(r.codes), r.error, r.label_error) for r in out.collect()) == want
    if rows:
        assert books.digest() == digest
    return books


def clustered(n, size, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(9, size)) * 3
    return [(k, (middles[rng.integers(9)] + rng.normal(size=size) * 0.2).tolist(), int(rng.integers(4)) or None) for k in range(n)]


def test_vector_codes_by_brute_force(spark):
    books = check(spark, clustered(700, 8, 1), entries=12)
    compared = [a / b for a, b in books.rescans]
    assert compared[0] == 1 and compared[-1] < 0.7, compared  # most keep their code without a look


def test_vector_codes_with_ties_and_equal_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k % 60), (rng.integers(-2, 3, 6) / 2).tolist(), int(k % 2)) for k in range(240)]
    rows += [(5, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5], None)] * 120
    check(spark, rows, parts=3, entries=20)


def test_vector_codes_of_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [nan, 0.0, 0.0, 0.0], 1), (4, [0.0, -inf, 0.0, 0.0], 1), (9, [0.0, 0.0, 0.0, 0.0], None)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0], None), (6, [], 2), (7, [-0.3, 0.7], 2), (8, [0.1, 0.2, 0.3, -0.00001, 5.0], 3), (8, [0.1, 0.2, 0.3, 0.4, 5.0], 3)]
    check(spark, rows, rounds=2)
    check(spark, rows, entries=1, rounds=1)
    check(spark, [(1, [3000.5, -2000.25, 1000.0, 0.0], 1), (2, [-3000.5, 2000.25, 1000.0, 9.0], 1), (3, [131000.0, 5.0, -131000.0, 0.5], 2)], rounds=1)
    check(spark, [])
    check(spark, rows[:4])
    with pytest.raises(Exception, match="64 bits"):
        check(spark, [(1, [1e30, 0.0, 0.0, 0.0], 1), (2, [-1e30, 0.0, 0.0, 0.0], 1)])


def test_one_label_holds_nearly_all_rows(spark):
    rows = [(k, v, 7 if k % 50 else None if k % 100 else k) for k, v, _ in clustered(400, 4, 8)]
    check(spark, rows, entries=5, rounds=1)


# Quality rules


def base_of(text):
    words = re.findall(WORD, text)
    runs = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if runs[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def verdicts(docs, labels):
    """Scores with dictionaries of counts, from (row, id, text) and {id: mean label}."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    is_trusted = lambda i: i is not None and labels.get(i, 0) >= 0.5 and not held(i)
    size = 1 << quality_rules.BITS

    def grams(text):
        data = re.sub(rb"[\x09-\x0D]", b" ", text.encode())
        out = collections.Counter()
        for n in (2, 3, 4):
            for k in range(len(data) - n + 1):
                number = int.from_bytes(bytes([n]) + data[k : k + n], "big")
                out[(number * 0x9E3779B97F4A7C15) % 2**64 >> (64 - quality_rules.BITS)] += 1
        return out

    found = [(i, t, grams(t), is_trusted(i)) for i, t in docs]
    raw, target = collections.Counter(), collections.Counter()
    for _, _, g, own in found:
        raw.update(g)
        if own:
            target.update(g)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    share = n_target / max(n_raw, 1)

    def score(g, own):
        n = sum(g.values()) if n_target else 0
        total = 0.0
        for k, times in g.items() if n else ():
            have, whole = target[k] - (times if own else 0), n_target - (n if own else 0)
            p = (have + share) / (max(whole, 1) + share * size)
            total += times * math.log(p / ((raw[k] + 1) / (max(n_raw, 1) + size)))
        return total / n if n else 0.0

    rows = []
    for i, t, g, own in found:
        base = base_of(t)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        rows.append((i, base, failed, score(g, own), own))
    good = sorted(math.floor(s * 1024) for _, _, failed, s, own in rows if own and not failed)
    limit = None
    if good:
        left = quality_rules.LOSS * len(good)
        limit = next(x for k, x in enumerate(good) if sum(y <= x for y in good) > left) / 1024
    return rows, limit


def agrees(out, rows, limit):
    got = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1][0], r[1][1]))
    assert len(got) == len(want)
    for a, (i, base, failed, score, _) in zip(got, want, strict=True):
        assert (a.doc_id, a.n_words, a.word_chars, a.n_symbols, a.n_dup_lines, a.n_repeat_words, a.base_failed) == (i, *base, failed)
        assert math.isclose(a.score, score, rel_tol=1e-9, abs_tol=1e-9)
        if limit is None or abs(score - limit) > 1e-9:
            assert a.kept == (not failed and (limit is None or score >= limit)), (i, score, limit)


def test_quality_rules_by_brute_force(spark, data):
    docs = [(r.doc_id, r.text or "") for r in table(spark, data, "documents").collect()]
    labels = {r.doc_id: r.quality for r in table(spark, data, "labels").collect()}
    agrees(apply_rules(table(spark, data, "documents"), table(spark, data, "labels")), *verdicts(docs, labels))


def test_quality_rules_tell_good_from_bad(spark):
    folder = "/root/testdata/sf0.01"
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    kept = QUERIES["op13_quality_rules"](spark, folder).join(table(spark, folder, "labels"), "doc_id").filter(F.col("n_words") >= 50)
    share = {r.quality: (r.kept, r.all) for r in kept.filter(held | (F.col("quality") == 0)).groupBy("quality").agg(F.count_if("kept").alias("kept"), F.count("*").alias("all")).collect()}
    assert share[1][0] >= 0.97 * share[1][1] and share[0][0] <= 0.1 * share[0][1], share


def test_quality_rules_of_odd_rows(spark):
    plain = " ".join(f"word{k % 37} and{k}" for k in range(60))
    texts = [None, "", " \t\n\v\f\r ", "\n\na\n\na \na", "x", "a b c a b c", "|#*$%&<> é 😀", plain, plain, plain.upper() + " ###", "so it goes " * 40, "w" * 300_000, "a\x00b c", "line one\n" * 60]
    rows = [(k, t, None, None, None, "y") for k, t in enumerate(texts)] + [(None, plain, None, None, None, None), (7, plain, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("extra", "trusted").withColumn("score", F.lit("s")).withColumn("trusted_id", F.lit(3))
    docs = docs.repartition(2)
    known = spark.createDataFrame([(7, 1), (8, 1), (8, 0), (9, 0), (None, 1), (6, None), (11, 1)], "doc_id long, quality int")
    pairs = [(i, t or "") for i, t, *_ in rows]
    agrees(apply_rules(docs, known), *verdicts(pairs, {7: 1, 8: 0.5, 9: 0, 11: 1}))
    agrees(apply_rules(docs, known.limit(0)), *verdicts(pairs, {}))
    assert apply_rules(docs.limit(0), known).count() == 0


def test_trusted_ids_are_bounded(spark):
    labels = spark.range(4000).selectExpr("id AS doc_id", "1 AS quality")
    for most in (10, 500):
        found = quality_rules.trusted_ids(labels, most).count()
        assert 0 < found <= most
    assert quality_rules.trusted_ids(labels).count() == labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).count()


def test_all_trusted_documents_are_counted(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} text {k} of many words " * 12) for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(0, 300, 2)], "doc_id long, quality int")
    few, all_of_them = (sorted(map(str, quality_rules.apply_rules(docs, labels, most=n).select("doc_id", "score", "threshold", "kept").collect())) for n in (5, 200_000))
    assert few == all_of_them
