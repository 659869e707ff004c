import hashlib
import random
import re

from ledgerlens.llm.queries import QUERIES
from ledgerlens.llm.secrets import all_spans, digest, find_secrets, redacted, train_ratio
from llm_helpers import SMALL

KINDS = ["assign", "access", "hex"]


def plain_spans(text):
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    assign = re.compile(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def check(rows, texts):
    for r in rows:
        spans = plain_spans(texts[r["doc_id"]] or "")
        joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[1] == i for s in spans) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("markov")] == [s for s in joined.split(",") if s]


def test_query_against_plain_patterns(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = QUERIES["op8_markov_secrets"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_patterns_at_their_edges(spark):
    hex32 = "0123456789abcdef" * 2
    texts = {
        1: f'ü token = "{hex32}" Token:abc toKEN=abcdefgh',
        2: "AKIA AKIA0123456789AB AKIA0123456789ABC xAKIAZZZZZZZZZZZZZZ password : 'secret=12345678",
        3: f"{hex32}0{hex32} {hex32[:31]} g{hex32}g api_key: 1234567 apikey='12345678'",
        4: "ſecret=abcdefgh1 toKen=abcdefgh1 token=token=abcdefgh",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(digest(find_secrets(df, train_ratio(df))).collect(), texts)


def test_models_part_random_tokens_from_identifiers(spark):
    draw = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    ratio = train_ratio(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    random_tokens = ["".join(draw.choices(letters, k=32)) for _ in range(100)]
    names = ["theOtherThing2_handler_of_all", "read_the_other_and_the_thing_3", "theringtionandherthinger2", "not-the-only-one-in-there-4"]
    hit = lambda t: bool(all_spans(f"see {t} here", f"see {t} here".encode(), ratio))
    assert sum(map(hit, random_tokens)) >= 97
    assert not any(map(hit, names)) and not hit("4845168114407329484516811440")


def test_odd_rows(spark, odd_documents, no_documents):
    ratio = train_ratio(no_documents)
    assert ratio.shape == (66, 66) and abs(ratio).max() < 1e-12
    rows = digest(find_secrets(odd_documents, train_ratio(odd_documents))).collect()
    assert len(rows) == odd_documents.count() and {r["n_hex"] for r in rows} == {0}
    assert {r["base_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert find_secrets(no_documents, ratio).count() == 0
    one = spark.createDataFrame([(1, "a token=abcdefgh12 b"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in redacted(one, ratio).collect()} == {1: "a [secret] b", 2: None}
