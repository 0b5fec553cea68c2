"""Every operator on awkward tables: nulls anywhere, empty and long texts, ties, repeated rows, no rows, clashing column names."""

from __future__ import annotations

import pytest

from polyloom.llm.fingerprint import fingerprints
from polyloom.llm.lines import removed_lines, without_boilerplate
from polyloom.llm.mixing import mixture, sampled
from polyloom.llm.packing import pack
from polyloom.llm.pii import personal_data
from polyloom.llm.polyhash import exact_duplicates
from polyloom.llm.revisits import resolve_revisits
from polyloom.llm.secrets import secret_findings
from polyloom.llm.simhash import near_groups, without_near
from polyloom.llm.toxicity import toxic_documents, without_toxic

CLASHES = ["digest", "content", "row", "own", "h", "drop", "first", "keep", "group_id", "topic", "u", "probability", "tokens", "id", "n", "f", "x", "score", "label_id", "site", "doc", "component"]
SCHEMA = "doc_id long, text string, source string, lang string, " + ", ".join(f"{c} string" for c in CLASHES)
LONG = " ".join(f"word{i} and\n" for i in range(40_000)) + "mail anna.bell@mail1.example.com"
TEXTS = [
    (1, "one two three four five six seven", "a", "en"),
    (1, "one two three four five six seven", "a", "en"),
    (2, "one two three four five six seven", None, None),
    (None, "one two three four five six seven", "b", "en"),
    (None, None, None, None),
    (3, None, "a", "en"),
    (4, "", "a", "en"),
    (5, "", "b", "de"),
    (6, " \n\t ", "b", "de"),
    (7, LONG, "c", "fr"),
    (8, "ÄÖÜ ퟿\U0001f600 é", "c", "fr"),
]
LABELS = "doc_id long, quality int, toxic int"


def table(spark, rows):
    return spark.createDataFrame([(*r, *CLASHES) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 1, 1), (7, None, None), (8, 1, 0), (8, 1, 1)], LABELS)


ROWS = [fingerprints, mixture, secret_findings, personal_data, exact_duplicates, pack, near_groups, removed_lines]
KEEPERS = [without_boilerplate, without_near, sampled]


@pytest.mark.parametrize("f", ROWS, ids=lambda f: f.__name__)
def test_awkward_and_empty_tables_give_a_result(spark, docs, f):
    full = f(docs)
    assert full.count() == len(full.collect())
    none = f(docs.limit(0))
    assert none.columns == full.columns and none.count() == 0


@pytest.mark.parametrize("f", KEEPERS, ids=lambda f: f.__name__)
def test_stages_keep_all_columns(spark, docs, f):
    out = f(docs)
    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    for row in out.collect():
        assert [row[c] for c in CLASHES] == CLASHES
    assert f(docs.limit(0)).count() == 0


def test_toxicity_stage(spark, docs, labels):
    assert without_toxic(docs, labels).columns == docs.columns
    assert {r["doc_id"] for r in without_toxic(docs, labels).where("text is null").collect()} == {None, 3}
    for l_ in (labels.limit(0), labels.where("toxic = 0")):  # nothing to learn from: nothing goes
        assert toxic_documents(docs, l_).count() == 0
        assert without_toxic(docs, l_).count() == len(TEXTS)
    assert toxic_documents(docs.limit(0), labels).count() == 0


def test_fingerprints(docs):
    rows = fingerprints(docs).collect()
    assert len(rows) == len(TEXTS)
    by = sorted((r["doc_id"] or 0, r["group_id"] or 0, r["group_size"]) for r in rows)
    assert by == [(0, 0, 1), (0, 1, 4), (1, 1, 4), (1, 1, 4), (2, 1, 4), (3, 3, 1), (4, 4, 3), (5, 4, 3), (6, 4, 3), (7, 7, 1), (8, 8, 1)]
    assert sum(r["fingerprint"] is None for r in rows) == 2


def test_exact_duplicates(docs):
    rows = exact_duplicates(docs).collect()
    got = sorted((r["doc_id"] or 0, r["group_id"], r["group_size"], r["is_first"]) for r in rows)
    assert got == [(0, 1, 4, False), (1, 1, 4, True), (1, 1, 4, True), (2, 1, 4, False), (4, 4, 2, True), (5, 4, 2, False)]


def test_near_groups_keep_one_row(docs):
    rows = near_groups(docs).collect()
    assert sorted((r["doc_id"] or 0, r["group_id"], r["group_size"], r["keep"]) for r in rows) == [(0, 1, 4, False), (1, 1, 4, True), (1, 1, 4, True), (2, 1, 4, False)]
    left = without_near(docs)
    assert sorted((r["doc_id"] or 0) for r in left.select("doc_id").collect()) == [0, 1, 3, 4, 5, 6, 7, 8]


def test_packing(docs):
    n = {}
    for r in pack(docs, 4).collect():
        n.setdefault(r["doc_id"] or 0, []).append((r["piece"], r["start"], r["length"], r["text"]))
    assert sorted(n) == [0, 1, 2, 6, 7, 8]
    assert sorted(n[2]) == [(0, 0, 4, "one two three four"), (1, 4, 2, " five six"), (2, 6, 1, " seven")]
    assert "".join(p[3] for p in sorted(n[7])) == LONG
    assert len(n[1]) == 6 and n[6] == [(0, 0, 1, " \n\t ")]


def test_mixture_counts(docs):
    rows = mixture(docs).collect()
    assert len(rows) == len(TEXTS)
    assert {(r["tokens"], r["topic"]) for r in rows if r["doc_id"] in (3, 4)} == {(0, "prose")}
    assert len({(r["probability"], r["sampled"]) for r in rows if r["doc_id"] == 1}) == 1


def test_findings_of_repeated_rows(spark):
    text = 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" for anna.bell@mail1.example.com'
    docs = table(spark, [(1, text, "a", "en"), (1, text, "a", "en"), (None, text, None, None)])
    assert secret_findings(docs).count() == 3 and personal_data(docs).count() == 3


def test_long_text_is_read_whole(docs):
    assert [(r["doc_id"], r["value"]) for r in personal_data(docs).collect()] == [(7, "anna.bell@mail1.example.com")]


def test_revisits(spark):
    schema = "record_id long, url string, ts long, kind string, headers map<string,string>, payload_digest string, payload_bytes int, url_key string, r string, status string"
    rows = [
        (1, "http://a.org/x", 10, "response", {"etag": '"1"', "content-length": "5", "cache-control": "a"}, "d1", 5),
        (2, "http://a.org/x", 20, "response", {"etag": '"2"'}, "d2", 6),
        (3, "http://a.org/x", 20, "response", {"etag": '"3"', "x": "y"}, "d3", 7),  # a tie in time
        (10, "https://www.a.org/x/#top", 15, "revisit", {"etag": 'W/"1"', "content-length": "0", "cache-control": "b"}, None, None),
        (10, "https://www.a.org/x/#top", 15, "revisit", {"etag": 'W/"1"', "content-length": "0", "cache-control": "b"}, None, None),
        (11, "http://a.org/x", 10, "revisit", {"etag": '"1"'}, None, None),
        (12, "http://a.org/x", 30, "revisit", {"etag": '"2"'}, None, None),
        (13, "http://a.org/x?utm_source=z", 30, "revisit", None, None, None),
        (14, None, 30, "revisit", {"etag": '"2"'}, None, None),
        (15, "http://a.org/x", None, "revisit", {"etag": '"2"'}, None, None),
        (16, "", 30, "revisit", {}, None, None),
    ]
    records = spark.createDataFrame([(*r, "u", "r", "s") for r in rows], schema)
    got = sorted((r["record_id"], r["status"], r["response_id"], r["headers"], r["payload_digest"]) for r in resolve_revisits(records).collect())
    merged = 'cache-control: b\ncontent-length: 5\netag: W/"1"'
    assert got == [
        (10, "resolved", 1, merged, "d1"), (10, "resolved", 1, merged, "d1"), (11, "no_response", None, None, None), (12, "mismatch", 3, None, None),
        (13, "unverified", 3, 'etag: "3"\nx: y', "d3"), (14, "unplaced", None, None, None), (15, "unplaced", None, None, None), (16, "no_response", None, None, None),
    ]
    assert resolve_revisits(records.limit(0)).count() == 0


def test_only_full_responses_answer_revisits(spark):
    schema = "record_id long, url string, ts long, kind string, headers map<string,string>, payload_digest string, payload_bytes int, http_status int"
    tag = {"etag": '"1"'}
    rows = [
        (1, "http://a.org/x", 10, "response", tag, "d1", 5, 200),
        *[(k, "http://a.org/x", 10 + k, "response", tag, f"d{k}", 5, status) for k, status in ((2, 206), (3, 404), (4, 301), (5, None))],
        (10, "http://a.org/x", 30, "revisit", tag, None, None, 304),
        (6, "http://a.org/y", 10, "response", tag, "d6", 5, 206),
        (11, "http://a.org/y", 30, "revisit", tag, None, None, 304),
    ]
    got = sorted((r["record_id"], r["status"], r["response_id"], r["payload_digest"]) for r in resolve_revisits(spark.createDataFrame(rows, schema)).collect())
    assert got == [(10, "resolved", 1, "d1"), (11, "no_response", None, None)]


def test_removed_lines_of_awkward_rows(spark):
    """A null site is no site; of tied places one copy stays; repetitions of the row that keeps a line keep it too; a very long text loses its line."""
    line, other = "a line that more than ten sites carry", "a line that nine sites and rows without one carry"
    long = "\n".join([f"own line number {i} of the long text" for i in range(30_000)] + [line])
    rows = [(100 + i, f"{line}\nown words of text {i}", f"s{i}", "en") for i in range(12)]
    rows += [(200 + i, f"{other}\nmore words of text {i}", f"s{i}" if i < 9 else None, "en") for i in range(14)]
    rows += [(50, f"{line}\n{line}\nfirst", "s0", "en")] * 3  # the least place, three times, and a second place within the row
    rows += [(None, f"{line}\nwithout an id", None, None), (60, long, "s1", "en"), (61, line, "s2", "en"), (62, None, "s3", "en"), (63, "", None, "en")]
    docs = table(spark, rows)
    got = sorted((r["doc_id"] or 0, r["removed"], r["kept"], r["text"]) for r in removed_lines(docs).collect())
    want = [(0, 1, 1, "without an id")] + [(50, 1, 2, f"{line}\nfirst")] * 3 + [(60, 1, 30_000, long[: -len(line) - 1]), (61, 1, 0, "")] + [(100 + i, 1, 1, f"own words of text {i}") for i in range(12)]
    assert got == want
    left = without_boilerplate(docs)
    assert left.columns == docs.columns and left.count() == len(rows) - 1  # only the text that was nothing but the line goes
    assert {r["doc_id"]: r["text"] for r in left.where("doc_id in (62, 63)").collect()} == {62: None, 63: ""}


def test_mixture_of_null_categories(spark):
    rows = [(i, "some words of a text", None if i % 2 else "a", None if i % 3 else "en") for i in range(60)] + [(None, "some words", None, None)] * 3
    out = mixture(table(spark, rows)).collect()
    assert len(out) == len(rows) and all(0 <= r["probability"] <= 1 and r["sampled"] is not None for r in out)
    assert {(r["source"], r["lang"]) for r in out} == {("a", "en"), ("a", None), (None, "en"), (None, None)}
    assert len({r["sampled"] for r in out if r["doc_id"] is None}) == 1
    kept = sampled(table(spark, rows)).collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == sorted((r["doc_id"] or -1) for r in out if r["sampled"])


def test_records_of_awkward_pages(spark):
    """A page without url or html gives records without them; its revisit has no place."""
    from polyloom.llm.revisits import crawl_records

    pages = spark.createDataFrame([(1, "http://a.org/x", "<p>", "k"), (2, None, "<p>", "k"), (4, "http://a.org/y", None, "k"), (5, "http://a.org/x", "<p>", "k"), (5, "http://a.org/x", "<p>", "k")], "page_id long, url string, html string, kind string")
    records = crawl_records(pages)
    assert records.count() == 10
    got = {(r["record_id"], r["status"]) for r in resolve_revisits(records).collect()}
    assert (5, "unplaced") in got and {k for k, _ in got} == {3, 5, 9, 11}
    assert crawl_records(pages.limit(0)).count() == 0


def test_batches_have_one_length(spark, tmp_path):
    from polyloom.llm.packing import buckets, write_batches

    docs = table(spark, [(i, " ".join(["w"] * (i % 50)), "a", "en") for i in range(400)] + [(None, "w w w", None, None), (3, None, "a", "en")])
    packed = pack(docs, 16, batch_tokens=64)
    rows = packed.collect()
    sizes = {}
    for r in rows:
        sizes[r["length"]] = sizes.get(r["length"], 0) + 1
    assert {r["length"]: r["bucket_pieces"] for r in buckets(docs, 16).collect()} == sizes and all(r["bucket_pieces"] == sizes[r["length"]] for r in rows)
    batches = {}
    for r in rows:
        batches.setdefault((r["length"], r["batch"]), []).append(r["length"])
    for length, n in sizes.items():
        mine = [len(v) for (k, _), v in batches.items() if k == length]
        assert len(mine) <= -(-n * length // 64) and sum(mine) == n and max(mine) <= 64 / length + 6 * (64 / length) ** 0.5 + 1
    write_batches(packed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == sorted(f"length={k}" for k in sizes)
    assert pack(docs.limit(0)).count() == 0


def test_copies_of_one_page_are_aggregated_before_they_travel(spark):
    """A third of all rows in one group: no window, no task that gets them all, and the same result."""
    from pyspark.sql import functions as F

    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the hot page " * 50).otherwise(F.concat(F.lit("page "), F.col("id").cast("string"))).alias("text"))
    for found in (fingerprints(docs).where("group_size > 1"), exact_duplicates(docs)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan
        r = found.groupBy("group_id", "group_size").count().collect()
        assert [tuple(x) for x in r] == [(0, 20_000, 20_000)]
