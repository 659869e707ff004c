import random
from collections import Counter

import numpy as np

from ledgerlens.llm import quality
from ledgerlens.llm.queries import QUERIES
from llm_helpers import SMALL, split_words


def base(text):
    text = text or ""
    w = split_words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if split_words(x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(w) < 10 or 100 * len(covered) > 20 * len(w),
    )


def test_query_base_columns_against_plain_counts(spark, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op7_robust_outliers"](spark, SMALL).collect()}
    for d in documents.collect():
        r = rows[d["doc_id"]]
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == base(d["text"])
        assert r["kept"] == (not r["base_failed"] and r["distance"] <= r["limit"])
    assert len(rows) == documents.count()


def test_estimates_equal_plain_concentration_steps(spark):
    """One group: the same steps in numpy, with exact quantiles of the same rank."""
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(400, 5)) @ (np.eye(5) + 0.3 * np.tri(5, k=-1)) * 2
    vectors[:60] += np.array([25, -25, 25, -25, 25])
    df = spark.createDataFrame([("all", *map(float, v)) for v in vectors], ["grp", *quality._X])
    estimates = df.groupBy("grp").agg(*[quality.F.lit(0.0).alias("z")]).select(
        "grp",
        *[quality.F.lit(float(np.median(vectors[:, i]))).alias(f"m{i}") for i in range(5)],
        *[quality.F.lit(2.0 if i == j else 0.0).alias(f"c{i}{j}") for i in range(5) for j in range(i + 1)],
    )
    mean, chol = np.median(vectors, axis=0), 2 * np.eye(5)
    for _ in range(4):
        d2 = (np.linalg.solve(chol, (vectors - mean).T)[1:] ** 2).sum(axis=0)  # given the first
        cut = np.sort(d2)[int(np.ceil(quality.SHARE * len(d2))) - 1]
        inner = vectors[d2 <= cut]
        mean, chol = inner.mean(axis=0), np.linalg.cholesky(np.cov(inner.T, bias=True))
        distances = quality._with_distance(df, estimates)
        estimates = quality._estimates(distances.join(quality._cuts(distances), "grp").where("d2 <= cut"))
    row = estimates.first()
    assert np.allclose([row[f"m{i}"] for i in range(5)], mean, atol=1e-8)
    assert np.allclose([row[f"c{i}{j}"] for i in range(5) for j in range(i + 1)], chol[np.tril_indices(5)], atol=1e-8)
    assert np.abs(mean).max() < 2  # the shifted rows had no say


def reference_verdicts(rows):
    """distance and limit per row, in numpy with exact quantiles: the method once more, group by group."""
    raw = {}
    for i, text, lang, source in rows:
        w = split_words(text)
        n, chars = max(len(w), 1), max(sum(map(len, w)), 1)
        marks = sum(33 <= ord(c) < 127 and not c.isalpha() for c in text or "")
        capitals = sum("A" <= c <= "Z" for c in text or "")
        shares = [np.log(chars / n), np.log((marks + 1) / (chars + 20)), np.log((capitals + 1) / (chars + 20))]
        raw.setdefault((lang, source), []).append((i, len(w), [np.log1p(len(w)), *shares, np.log((n - len(set(w)) + 1) / (n + 2))]))

    def at(values, share):
        return np.sort(values, axis=0)[max(int(np.ceil(share * len(values))) - 1, 0)]

    def estimate(x):
        covariance, factor = np.cov(x.T, bias=True), np.zeros((5, 5))
        for i in range(5):
            for j in range(i + 1):
                rest = covariance[i, j] - factor[i, :j] @ factor[j, :j]
                factor[i, j] = np.sqrt(max(rest, quality.FLOORS[i] ** 2)) if i == j else rest / factor[j, j]
        return x.mean(axis=0), factor

    def distance(x, mean, factor):
        return (np.linalg.solve(factor, (x - mean).T)[1:] ** 2).sum(axis=0)

    def concentrated(x, found, steps):
        for _ in range(steps):
            d2 = distance(x, *found)
            found = estimate(x[d2 <= at(d2, quality.SHARE)])
        return found

    out = {}
    for members in raw.values():
        x, n = np.array([m[2] for m in members]), np.array([m[1] for m in members])
        x[:, 1:] = (x[:, 1:] - at(x[:, 1:], 0.5)) * np.sqrt(n / (n + quality.NOISE_WORDS))[:, None]
        points = np.unique(x, axis=0)
        middle = at(points, 0.5)
        box = np.diag(np.maximum((at(points, 0.75) - at(points, 0.25)) / 1.349, quality.FLOORS))
        away = np.maximum(np.sqrt((((points - middle) / np.diag(box)) ** 2).sum(axis=1)), 1e-9)
        starts = [(middle, box), estimate(points), estimate(middle + (points - middle) / away[:, None])]
        starts = [concentrated(points, s, quality.START_STEPS) for s in starts]
        best = concentrated(points, min(starts, key=lambda s: np.log(np.diag(s[1])).sum()), quality.STEPS)
        d2 = distance(points, *best)
        scale = quality.CHI_SHARE / max(at(d2, quality.SHARE), quality.CHI_SHARE / 4)
        reach = at(d2, 0.5) * scale * (at(d2, 0.5) / max(at(d2, 0.25), 1e-3)) ** quality.TAIL
        limit = min(max(reach, quality.LEAST_LIMIT), quality.MOST_LIMIT)
        out |= {m[0]: (d, limit) for m, d in zip(members, distance(x, *best) * scale, strict=True)}
    return out


def test_verdicts_equal_a_plain_version(spark):
    draw = random.Random(8)
    rows = []
    for i in range(360):
        words = ["".join(draw.choices("abcdefghijklmnoprstuABC,.", k=draw.randint(2, 9))) for _ in range(draw.randint(5, 90))]
        text = " ".join(draw.choices(words, k=draw.randint(10, 300)))
        rows.append((i, text + " ***" * draw.choice([0, 0, 0, 40]), ["en", "de", None][i % 3], "s"))
    rows += [(1000 + i, rows[0][1], "en", "s") for i in range(90)]  # copies have one say
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = reference_verdicts(rows)
    for r in quality.quality_verdicts(docs).collect():
        assert np.allclose((r["distance"], r["limit"]), want[r["doc_id"]], rtol=1e-6, atol=1e-9)


def test_floors_bind_in_no_group_and_few_clean_texts_go(spark):
    docs = spark.read.parquet(f"{SMALL.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = quality._vectors(quality.base_statistics(docs))
    points = rows.select("grp", *quality._X).distinct()
    found = quality._concentrated(points, quality._least_determinant(quality._starts(points)), ("grp",), 3).collect()
    assert found and all(r[f"c{i}{i}"] > 1.01 * quality.FLOORS[i] for r in found for i in range(5))
    out = {r["doc_id"]: r for r in quality.quality_verdicts(docs).collect()}
    noisy = lost = clean = caught = 0
    for d in docs.collect():
        r, odd = out[d["doc_id"]], r_odd(d["text"] or "")
        if not r["base_failed"]:
            noisy, caught = noisy + odd, caught + (odd and not r["kept"])
            clean, lost = clean + (not odd), lost + (not odd and not r["kept"])
    assert noisy and caught >= 0.9 * noisy and lost <= 0.02 * clean


def r_odd(text):
    """Strewn with symbols, bars or capitals."""
    capitals = sum("A" <= c <= "Z" for c in text)
    return sum(c in quality.SYMBOLS for c in text) > 10 or capitals > 0.3 * len(text)


def test_junk_is_rejected_and_prose_kept(spark):
    draw = random.Random(2)
    words = ["".join(draw.choices("abcdefghijklmnoprstu", k=draw.randint(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(300):
        text = " ".join(draw.choices(words, k=draw.randint(60, 400)))
        if i % 10 == 0:
            text = " ".join(w + "***###" for w in text.split())
        elif i % 10 == 1:
            text = text.upper()
        rows.append((i, text, "en", "s"))
    out = quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert not any(kept[i] for i in kept if i % 10 < 2)
    assert sum(kept[i] for i in kept if i % 10 >= 2) >= 0.98 * sum(i % 10 >= 2 for i in kept)


def test_odd_rows(spark, odd_documents, no_documents):
    rows = quality.quality_verdicts(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert all(r["distance"] is not None and np.isfinite(r["distance"]) for r in rows)
    assert {(r["doc_id"], r["n_words"], r["base_failed"]) for r in rows if r["doc_id"] in (1, 2, 3, 7)} == {
        (1, 0, True), (2, 0, True), (3, 0, True), (7, 10, False),
    }
    assert quality.quality_verdicts(no_documents).count() == 0


def test_windows_of_a_very_long_text_are_told_apart(spark):
    """Two windows whose hashes agree in their first 38 bits, among 70,000 words with one true repeat."""
    alike = [f"w{i + k}" for i in (1145533, 1212215) for k in range(5)]
    text = " ".join([f"x{i}" for i in range(70_000)] + alike[:5] + ["y"] + alike[5:] + [f"x{i}" for i in range(5)])
    row = quality.base_statistics(spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string"))
    assert base(text)[4] == 10
    assert row.first()["n_repeat_words"] == 10
