from collections import Counter, defaultdict

from ledgerlens.llm.line_dedup import drop_boilerplate_lines

SCHEMA = "doc_id long, text string, source string"


def test_lines_of_distinct_pages_over_the_ratio_go(spark):
    rows = [(i, f"Menu\nbody {i}\n  Menu  \n\nshared {i % 40}", "site") for i in range(200)]
    rows += [(1000 + i, "copied page\nall over", "site") for i in range(80)]
    rows += [(2000 + i, "Menu\nonly few", None) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    pages = defaultdict(set)
    for _, text, host in rows:
        pages[host].add(text)
    lines = Counter((h, x) for h, texts in pages.items() for t in texts for x in {y.strip() for y in t.split("\n")} if x)
    expected = {}
    for i, text, host in rows:
        kept = [
            x for x in text.split("\n")
            if not (lines[host, x.strip()] >= 5 and lines[host, x.strip()] > 0.02 * len(pages[host]))
        ]
        expected[i] = ("\n".join(kept), len(text.split("\n")), len(text.split("\n")) - len(kept))
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in drop_boilerplate_lines(df).collect()}
    assert got == expected
    assert got[3][0] == "body 3\n\nshared 3" or got[3][0] == "body 3\n"
    assert got[1005][0] == "copied page\nall over" and got[2001][0] == "Menu\nonly few"


def test_odd_rows(spark, odd_documents, no_documents):
    out = drop_boilerplate_lines(odd_documents)
    assert out.columns == [*odd_documents.columns, "n_dropped"]  # its own n_lines is replaced
    rows = out.collect()
    assert len(rows) == odd_documents.count()
    assert {str(r["doc_id"]): r["text"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"1": None, "2": "", "3": " \t\n \n"}
    assert {r["n_dropped"] for r in rows} == {0}
    assert {r["n_lines"] for r in rows if r["doc_id"] == 7} == {2}
    assert drop_boilerplate_lines(no_documents).count() == 0
