import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
from ledgerlens.llm.common import table
from ledgerlens.llm.decontaminate import ERROR_RATE, myers_best, normal
from llm_helpers import SMALL, split_words
from test_near_dup import brute_force


def stages(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        yield name, before, docs


def test_stages_take_effect(spark):
    docs = table(spark, SMALL, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for name, before, after in stages(spark, docs, SMALL):
        if name != "mixing":
            assert after.columns == before.columns
        ids = [r["doc_id"] for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) <= before.count()
        if name == "line_dedup":
            assert len(ids) == before.count()
    assert after.columns == [*docs.columns, "topic", "n_tokens", "probability"]
    again = corpus_pipeline.run(spark, SMALL)
    assert sorted(r["doc_id"] for r in again.collect()) == sorted(ids)


def test_odd_rows_go_through(spark, odd_documents, no_documents):
    counts = {}
    for name, _, after in stages(spark, odd_documents, SMALL):
        counts[name] = after.count()
    assert counts["toxicity"] == counts["line_dedup"] == odd_documents.count()
    assert counts["near_dedup"] == odd_documents.count() - 2  # a copy, and a repeated id
    for name, _, after in stages(spark, no_documents, SMALL):
        assert after.count() == 0


def test_of_a_repeated_id_the_same_row_stays(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa "
    rows = [(1, f"{long} {i % 5} of {i % 7} texts", "en", f"s{i % 3}", 1) for i in range(60)] + [(2, "other text", "en", "s", 1)] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    kept = set()
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(rows, schema).repartition(parts)
        out = corpus_pipeline.near_dedup(spark, docs, "").collect()
        assert sorted(r["doc_id"] for r in out) == [1, 2]
        kept.add(tuple(sorted(map(tuple, out))))
    assert len(kept) == 1


def planted(draw):
    """(documents, labels, benchmark, ids of toxic documents): 400 texts, and cases for every stage."""
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 9))) for _ in range(3000)]
    foul = ["zzug", "zzorx", "zzamp", "zzilt", "zzyre", "zzeck"]
    items = [" ".join(draw.choices(words, k=22)) for _ in range(4)]
    texts, toxic = {}, set()
    for i in range(400):
        lines = [" ".join(draw.choices(words, k=12)) for _ in range(draw.randint(4, 9))]
        if i % 10 == 3:
            lines.insert(1, " ".join(draw.choices(foul, k=14)))
            toxic.add(i)
        if i % 4 == 1:
            lines.append("\t share this page with all of your friends ")  # its source's boilerplate
        if i in (2, 6, 18):
            lines.append("a line that stands on three pages of its source only")
        if i in (40, 41):
            lines.insert(2, items[0])
        if i == 42:  # within the budget
            lines.insert(2, items[1][:30] + "qq" + items[1][33:70].upper() + items[1][71:])
        if i == 44:  # beyond it
            lines.insert(2, items[2][:40] + "".join(draw.choices("uvwxyz", k=30)) + items[2][70:])
        texts[i] = "\n".join(lines)
    for i in (50, 52, 54):
        texts[500 + i] = texts[600 + i] = texts[i]
        near = texts[i].split(" ")
        near[-3] = "changed"
        texts[700 + i] = " ".join(near)
    texts |= {800: "", 801: None, 802: "one two", 803: "one two"}
    rows = [(i, t, "xx" if i % 7 == 0 else "en", f"s{i % 4}", len(t or "")) for i, t in texts.items()]
    rows += [rows[60], rows[61]]  # repeated rows
    return rows, [(i, int(i in toxic)) for i in range(400)], list(enumerate(items)), toxic


def plain_lines(rows):
    """Rows without lines of over 2 % and at least 5 of their source's distinct texts."""
    pages, holders = defaultdict(set), defaultdict(set)
    for _, text, _, source, _ in rows:
        if text is not None:
            pages[source].add(text)
            for line in text.split("\n"):
                holders[source, line.strip()].add(text)

    def stays(source, line):
        n = len(holders[source, line.strip()])
        return not line.strip() or n < 5 or n <= 0.02 * len(pages[source])

    out = []
    for i, text, lang, source, n in rows:
        cut = None if text is None else "\n".join(x for x in text.split("\n") if stays(source, x))
        out.append((i, cut, lang, source, n if cut == text else len(cut)))
    return out


def plain_mixing(rows):
    """{doc_id: probability} of the rows that are drawn."""
    tokens = Counter()
    for _, text, lang, source, _ in rows:
        tokens[source, lang] += len(split_words(text))
    cells = {c: float(n) for c, n in tokens.items() if n}
    total = sum(cells.values())
    goals = []
    for at, power in ((0, 0.7), (1, 0.7)):
        sums = Counter()
        for c, n in cells.items():
            sums[c[at]] += n
        norm = sum((n / total) ** power for n in sums.values())
        goals.append({v: (n / total) ** power / norm * total for v, n in sums.items()})
    for _ in range(200):
        for at in (0, 1):
            now = Counter()
            for c, n in cells.items():
                now[c[at]] += n
            cells = {c: n * goals[at][c[at]] / now[c[at]] for c, n in cells.items()}
    ratio = {c: cells[c] / tokens[c] for c in cells}
    low, high = 0.0, max(ratio.values())

    def share(top):
        return sum(tokens[c] * min(1.0, ratio[c] / top) for c in ratio) / total

    if share(high) < 0.5:
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if share(middle) >= 0.5 else (low, middle)
    out = {}
    for i, text, lang, source, _ in rows:
        chance = min(1.0, ratio[source, lang] / high) if split_words(text) else 1.0
        if int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) / 2**48 < chance:
            out[i] = chance
    return out


def test_rows_after_each_stage_equal_a_plain_version(spark, tmp_path):
    rows, labels, items, toxic = planted(random.Random(11))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    calm = [r for r in rows if r[0] not in toxic]
    cut = plain_lines(calm)
    assert sum(a[1] != b[1] for a, b in zip(calm, cut, strict=True)) > 80
    kept_ids = {i for i, (_, _, kept) in brute_force({r[0]: r[1] for r in cut}, 5, 80).items() if kept}
    single = sorted({r for r in cut if r[0] in kept_ids}, key=lambda r: r[0])
    assert not {550, 650, 750, 552, 652, 752, 554, 654, 754, 803} & kept_ids and {50, 52, 54, 800, 801, 802} <= kept_ids

    def leaks(text):
        return any(myers_best(normal(item), normal(text))[0] <= int(ERROR_RATE * len(normal(item))) for _, item in items)

    clean = [r for r in single if not leaks(r[1] or "")]
    assert {r[0] for r in single} - {r[0] for r in clean} == {40, 41, 42}
    want = {"toxicity": calm, "line_dedup": cut, "near_dedup": single, "decontamination": clean}

    for name, _, after in stages(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)):
        if name in want:
            assert Counter(map(tuple, after.collect())) == Counter(want[name]), name
    drawn = plain_mixing(clean)
    got = {r["doc_id"]: r["probability"] for r in after.collect()}
    assert set(got) == set(drawn) and len(drawn) > 100
    assert all(abs(got[i] - drawn[i]) < 1e-6 for i in drawn)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(drawn)
