"""What the weak supervision adds to the base spans: planted wider forms among real documents."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from quarry.llm import pii

FORMS = {
    "email": lambda i: ("Write to ", f"anna.m{i} [at] {('gmail', 'firma', 'example')[i % 3]} [dot] {('com', 'de', 'org')[i % 3]}", " today"),
    "phone": lambda i: ("Her phone is ", f"({200 + i % 700}) 555-{1000 + i}" if i % 2 else f"0{20 + i % 70}-555-{1000 + i}", " at night"),
    "ip": lambda i: ("the host ", f"2001:db8:{i % 9000:x}::{i % 99 + 1}", " answered"),
    "card": lambda i: ("paid by card ", _card(i), " in May"),
}
OTHER = [
    lambda i: f"of 12 345 {6000 + i} units", lambda i: f"at 12:30:45:{10 + i % 50} it", lambda i: f"order 1234/5678/9012/{3001 + i} was", lambda i: f"score [at] home {i}", lambda i: f"see a{i} @ noon.Next",
]


def _card(i: int) -> str:
    """Sixteen digits of which the checksum is right, apart in a way that the base pattern does not take."""
    digits = [4, 1, 1, 1, *map(int, f"{i:011d}")]
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits))
    d = "".join(map(str, [*digits, -total % 10]))
    return ".".join(d[k : k + 4] for k in range(0, 16, 4))


def planted(n: int) -> tuple[list, dict]:
    rows, want = [], {}
    for k, (kind, make) in enumerate(FORMS.items()):
        for i in range(n):
            before, span, after = make(i)
            rows.append((1_000_000 + 10_000 * k + i, f"Some é text. {before}{span}{after}"))
            want[rows[-1][0]] = (len("Some é text. " + before), len("Some é text. " + before + span), kind)
    for k, make in enumerate(OTHER):
        rows += [(2_000_000 + 10_000 * k + i, make(i)) for i in range(n)]
    return rows, want


def judged(spark, docs, n):
    rows, want = planted(n)
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found = pii.find(df).select("doc_id", "base", F.array_except("spans", "base").alias("more")).where("doc_id >= 1000000").collect()
    added = {(r["doc_id"], s["start"], s["end"], s["kind"]) for r in found for s in r["more"]}
    right = {(i, *w) for i, w in want.items()}
    of = Counter(x[3] for x in added & right)
    return {k: of[k] / n for k in FORMS}, len(added & right) / max(1, len(added))


def test_wider_forms_are_found_and_others_left(spark, data):
    recall, precision = judged(spark, spark.read.parquet(f"{data}/documents.parquet"), 60)
    assert min(recall.values()) >= 0.9 and precision >= 0.9, (recall, precision)


def test_a_few_rows_by_themselves(spark):
    recall, precision = judged(spark, spark.createDataFrame([], "doc_id long, text string"), 2)
    assert min(recall.values()) == 1 and precision == 1, (recall, precision)


def test_base_spans_do_not_depend_on_what_is_added(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows, _ = planted(40)
    base = lambda df: {r["doc_id"]: [tuple(s) for s in r["base"]] for r in pii.find(df).collect()}
    alone, among = base(docs), base(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(among[i] == spans for i, spans in alone.items())


def test_one_labeler_by_itself_is_not_believed():
    _, _, belief = pii.reliabilities([((True, True, True), 300), ((False, False, True), 300), ((True, False, False), 300), ((True, False, True), 50), ((True, True, False), 50)])
    assert belief[(True, True, True)] > 0.9 and max(belief[(False, False, True)], belief[(True, False, False)]) < 0.2
    assert belief[(True, False, True)] > belief[(False, False, True)] and belief[(True, True, False)] > belief[(True, False, False)]
