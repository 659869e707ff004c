import random

from ledgerlens.llm.decontaminate import benchmark_hits, decontaminated, myers_best, normal
from ledgerlens.llm.queries import QUERIES
from llm_helpers import SMALL

BENCH = "item_id long, text string"


def slow_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
    return min(row), row.index(min(row))


def test_bit_parallel_distance_equals_dynamic_programming():
    draw = random.Random(3)
    for _ in range(500):
        item = "".join(draw.choices("abc", k=draw.randint(1, 80)))
        text = "".join(draw.choices("abc", k=draw.randint(0, 120)))
        assert myers_best(item, text) == slow_distance(item, text)


def test_every_occurrence_within_budget_is_found(spark):
    draw = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    items = [(i, "".join(draw.choices(letters, k=draw.randint(60, 200)))) for i in range(12)]
    docs = []
    for n in range(150):
        text = list(normal(items[n % 12][1]))
        for _ in range(draw.randint(0, 22)):
            at = draw.randrange(len(text))
            kind = draw.randrange(3)
            if kind == 0:
                text[at] = draw.choice(letters)
            elif kind == 1:
                text.insert(at, draw.choice(letters))
            else:
                del text[at]
        docs.append((n, "".join(draw.choices(letters, k=300)) + "".join(text).upper() + " tail " * 20))
    hits = benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, BENCH))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in hits.collect()}
    expected = {}
    for n, text in docs:
        for i, item in items:
            distance = slow_distance(normal(item), normal(text))[0]
            if distance <= int(0.08 * len(normal(item))):
                expected[n, i] = distance
    assert got == expected and len(got) > 50


def test_query_against_plain_search(spark, documents):
    rows = QUERIES["op2_pigeonhole_decontamination"](spark, SMALL).collect()
    items = [(r["item_id"], normal(r["text"])) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    exact = {(d["doc_id"], i) for d in documents.collect() for i, t in items if t in normal(d["text"] or "")}
    assert exact and exact <= {(r["doc_id"], r["item_id"]) for r in rows}


def test_odd_rows(spark, odd_documents, no_documents):
    items = [(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"), (3, None), (4, " ")]
    bench = spark.createDataFrame(items + [(None, "eta theta iota")], BENCH)
    hits = benchmark_hits(odd_documents, bench)
    assert {(r["doc_id"], r["item_id"]) for r in hits.collect()} == {
        (None, 1), (None, 2), (7, 1), (7, 2), (7, None),
    }
    clean = decontaminated(odd_documents, bench)
    assert clean.schema == odd_documents.schema
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(["1", "2", "3", "4", "5", "6", "None"])
    assert benchmark_hits(no_documents, bench).count() == 0 == decontaminated(no_documents, bench).count()
    nothing = spark.createDataFrame([], BENCH)
    assert benchmark_hits(odd_documents, nothing).count() == 0
    assert decontaminated(odd_documents, nothing).count() == odd_documents.count()


def test_two_benchmarks_in_one_session(spark):
    docs = spark.createDataFrame([(i, f"noise {'abcdefgh'[i] * 3} words of item number {i} stand here " * 3) for i in range(8)], "doc_id long, text string")
    for i in range(8):
        bench = spark.createDataFrame([(i, f"{'abcdefgh'[i] * 3} words of item number {i} stand here")], BENCH)
        assert i not in {r["doc_id"] for r in decontaminated(docs, bench).collect()}


def test_cached_matcher_follows_its_block():
    from ledgerlens.llm.decontaminate import _matcher

    class Shared:
        def __init__(self, value):
            self.value = value

    for i in range(20):  # earlier blocks are freed, so addresses may come again
        text = f"block number {i} has a text of its own"
        assert _matcher(Shared([(i, text)]), 0.1).items[0][0] == i
