"""Tables of spans: dictionaries, contexts, disambiguation, evaluation, generators, columns, documents, streams."""

import io
import math
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from mistveil import queries as registered
from mistveil.operators import context, dictionary, disambiguation, evaluation, generators, splitting, tables
from mistveil.plans.policy import Policy
from mistveil.plans.redactor import Redactor, explode_spans, redact
from mistveil.sources import documents
from mistveil.streaming.redact import consistent_stream, redact_stream


def test_dictionaries_by_joins(spark):
    docs = spark.createDataFrame([(1, "in (New  York), paris"), (2, None), (3, "")], "doc_id long, text string")
    terms = spark.createDataFrame([("new york",), ("Paris",)], "term string")
    got = {(r.doc_id, r.character_start, r.text) for r in dictionary.exact_matches(docs, terms, 2).collect()}
    assert got == {(1, 4, "New  York"), (1, 16, "paris")}
    fuzzy = dictionary.fuzzy_matches(spark.createDataFrame([(1, "asprin asirin aspirin banana")], "doc_id long, text string"), spark.createDataFrame([("aspirin",)], "term string"), 1)
    assert {(r.text, r.distance) for r in fuzzy.collect()} == {("asprin", 1), ("asirin", 1), ("aspirin", 0)}


def test_lines_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    texts = ["a\r\nb\r\n", "", " \n ", "\n\n", "\t\n a", "\u00a0a\u3000\nb", "a\u2028b\x85", "\x00\n\x1f a", None, "one\r", "\u2003", " x y \n\n z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(tuple(r) for r in registered.queries()["split_newline"](spark, str(tmp_path)).collect())
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert rows == sorted(duckdb.sql(registered.oracle_sql()["split_newline"]).fetchall()) and len(rows) == 7
    blank = Policy({"identifiers": {"emailAddress": {}}, "config": {"splitting": {"enabled": True, "threshold": 0}}})
    assert [tuple(r) for r in redact(spark.createDataFrame([("",), (" \n",), ("a@b.co",)], "text string"), blank).select("filtered_text", F.size("spans")).collect()] == [("", 0), (" \n", 0), ("{{{REDACTED-email-address}}}", 1)]


def test_evaluation(spark):
    rows = lambda *x: spark.createDataFrame([(d, s, s + 2) for d, s in x], "doc_id long, character_start int, character_end int")
    r = evaluation.evaluate(rows((1, 0), (1, 5)), rows((1, 0), (2, 0))).first()
    assert (r.true_positives, r.false_positives, r.false_negatives, r.precision, r.recall, r.f1) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert evaluation.evaluate(rows((1, 0)).limit(0), rows((1, 0)).limit(0)).first().f1 == 0.0


def test_context_keeps_values(spark, tmp_path):
    table = context.ContextTable(spark, str(tmp_path / "context"))
    spans = spark.createDataFrame([("c", "a@b.co", "email-address", "x"), ("c", "a@b.co", "email-address", "x"), ("d", "a@b.co", "email-address", "x")], "context string, text string, filter_type string, replacement string")
    first = {(r.context, r.replacement) for r in context.consistent(spans, table, seed=1).collect()}
    assert len(first) == 2
    assert {(r.context, r.replacement) for r in context.consistent(spans, table, seed=2).collect()} == first
    table.clear("d")
    assert table.get("d", "a@b.co") is None and table.get("c", "a@b.co")


def test_murmur3_in_the_jvm(spark):
    words = ["", "a", "ab", "abc", "abcd", "hello", "Straße", "日本語", "x" * 37, "emoji 🎉"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", disambiguation.murmur3(F.col("w")).alias("h")).collect()
    assert {r.w: r.h for r in rows} == {w: disambiguation.murmur3_32(w.encode()) for w in words}


@pytest.mark.parametrize("by_column", [False, True])
@pytest.mark.parametrize("how", [disambiguation.Disambiguation(), disambiguation.Disambiguation(64, False, "hashCode"), disambiguation.Disambiguation(stop_words="visa, garage")])
def test_disambiguation_within_redact(spark, how, by_column):
    """Types by the words around: counted, normed and compared in plain Python."""
    from mistveil.plans.redactor import Redactor

    lines = ["border visa stamp A12345678 gate", "garage car wheel A123456789012 oil", "the border visa 123456789 gate", "a garage wheel 123456789 oil", "nothing 123456789", "visa garage 123456789 end"]
    rows = [(i, f"{lines[i % 6]} w{i % 4}", "ab"[i % 2] if by_column else "none") for i in range(60)]
    policy = Policy({"identifiers": {"driversLicense": {}, "passportNumber": {}}})
    df = spark.createDataFrame(rows, "i int, text string, c string").repartition(4)
    out = Redactor(policy).redact(df, context=F.col("c") if by_column else "none", disambiguation=how)
    got = {r.i: [(s.text, s.filter_type) for s in r.spans] for r in out.collect()}

    stop = how.stop_words.split(",") if isinstance(how.stop_words, str) else how.stop_words
    stop = {w.strip() for w in stop} if how.ignore_stop_words else set()

    def poly(w):
        h = 0
        for c in w:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    hashed = (lambda w: disambiguation.murmur3_32(w.encode())) if how.algorithm == "murmur3" else poly
    buckets = lambda t: {abs(int(math.fmod(hashed(w.lower()), how.size))) for w in t.split() if w.lower() not in stop}
    types = lambda token: ["passport-number"] if re.fullmatch("[A-Z][0-9]{8}", token) else ["drivers-license-number"] if token[0] == "A" else ["passport-number", "drivers-license-number"]
    number = lambda t: next(w for w in t.split() if w[-1].isdigit() and len(w) > 5)
    counts = {}
    for _, t, c in rows:
        if len(types(number(t))) == 1:
            own = counts.setdefault((c, types(number(t))[0]), {})
            for b in buckets(t):
                own[b] = own.get(b, 0) + 1

    def cosine(c, kind, near):
        v = counts.get((c, kind), {})
        return sum(v.get(b, 0) for b in near) / (len(near) ** 0.5 * sum(n * n for n in v.values()) ** 0.5) if v and near else 0.0

    want = {i: [(number(t), max(types(number(t)), key=lambda k: cosine(c, k, buckets(t))))] for i, t, c in rows}
    assert got == want and {k for v in want.values() for _, k in v} == {"passport-number", "drivers-license-number"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") or not by_column
    declined = Policy({"identifiers": policy.identifiers, "config": {"analysis": {"spanDisambiguation": False}}})
    same = Redactor(declined).redact(df, disambiguation=how).select("i", "filtered_text").exceptAll(Redactor(policy).redact(df).select("i", "filtered_text"))
    assert same.count() == 0


def test_disambiguation(spark):
    schema = "doc_id long, context string, filter_type string, character_start int, character_end int, ordinal int, window array<string>"
    rows = [(i, "c", t, 0, 9, 0, [w, "x"]) for i, (t, w) in enumerate([("ssn", "social"), ("phone", "call")] * 3)]
    rows += [(9, "c", "ssn", 0, 9, 0, ["call", "me"]), (9, "c", "phone", 0, 9, 1, ["call", "me"])]
    spans = spark.createDataFrame(rows, schema)
    for algorithm in ("murmur3", "polynomial"):
        vectors = disambiguation.train(spans, algorithm=algorithm)
        assert [r.filter_type for r in disambiguation.resolve(spans, vectors, algorithm=algorithm).where("doc_id = 9").collect()] == ["phone"]


def test_generators(spark):
    kinds = {k.replace("-", "_"): k for k in generators.KINDS}
    a = generators.table(spark, 50, kinds, seed=1, partitions=1)
    assert a.exceptAll(generators.table(spark, 50, kinds, seed=1, partitions=5)).count() == 0
    from mistveil.functions import validators

    assert a.where(~validators.luhn(F.col("credit_card")) | ~validators.luhn(F.col("canada_sin"))).count() == 0


def test_columns(spark):
    rows = spark.createDataFrame([(1, "123-45-6789", "x", None), (2, "none", "y", "a@b.co")], "id int, ssn string, name string, note string")
    got = tables.redact_columns(rows, Policy({"identifiers": {"ssn": {}, "emailAddress": {}}}), ["ssn", "note"], ["name"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "{{{REDACTED-ssn}}}", "{{{REDACTED}}}", None), (2, "none", "{{{REDACTED}}}", "{{{REDACTED-email-address}}}")]
    spans = tables.cell_spans(rows, Policy({"identifiers": {"ssn": {}}}), "ssn", header="SSN").where("id = 1").first().spans
    assert (spans[0].character_start, spans[0].confidence) == (0, 0.95)


def test_combine_and_saved_spans(spark):
    r = Redactor(Policy({"identifiers": {"emailAddress": {}}}))
    rows = spark.createDataFrame([(1, 0, "a@b.co x"), (1, 1, "y c@d.co")], "doc_id long, piece int, text string")
    got = splitting.combine(r.redact(rows), "doc_id").first()
    assert got.filtered_text == "{{{REDACTED-email-address}}} x\ny {{{REDACTED-email-address}}}" and got.tokens == 4
    docs = spark.createDataFrame([(1, "mail a@b.co"), (2, "no")], "doc_id long, text string")
    saved = explode_spans(r.redact(docs), "doc_id")
    assert {x.filtered_text for x in context.apply_spans(docs, saved).collect()} == {"mail {{{REDACTED-email-address}}}", "no"}


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    (tmp_path / "a.docx").write_bytes(_zip({"word/document.xml": f"<w:document {w}><w:p><w:r><w:t>write a@b</w:t></w:r><w:r><w:t>.co</w:t></w:r></w:p><w:p/></w:document>"}))
    files = documents.files(spark, str(tmp_path), "*.docx")
    out = documents.redact_docx(files, Redactor(Policy({"identifiers": {"emailAddress": {}}}))).first()
    assert out.spans == 1 and next(documents.docx_paragraphs(bytes(out.content)))[2] == "write {{{REDACTED-email-address}}}"
    x = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {x}><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>5</v></c></row></worksheet>'
    (tmp_path / "b.xlsx").write_bytes(_zip({"xl/workbook.xml": f'<workbook {x}><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {x}><si><t>age</t></si></sst>", "xl/worksheets/sheet1.xml": sheet}))
    got = [tuple(r)[1:] for r in documents.cells(documents.files(spark, str(tmp_path), "*.xlsx")).collect()]
    assert got == [("S", 1, 1, "A", None, "age"), ("S", 2, 1, "A", "age", "5")] and documents.letter(28) == "AB"


def test_page_geometry(spark):
    lines = spark.createDataFrame([("p", 1, 0, "mail a@"), ("p", 1, 1, "b.co now")], "path string, page int, line int, text string")
    page = documents.pages(lines).withColumn("spans", F.expr("array(named_struct('character_start', 5, 'character_end', 12))"))
    assert [(r.line, r.line_start, r.line_end) for r in documents.per_line(page).orderBy("line").collect()] == [(0, 5, 7), (1, 0, 4)]
    boxes = spark.sql("select array(named_struct('left',0d,'bottom',0d,'right',1d,'top',4d), null, named_struct('left',2d,'bottom',0d,'right',3d,'top',4d)) b")
    assert tuple(boxes.select(documents.padded_box(F.col("b"), F.lit(0), F.lit(3))).first()[0]) == (-2.0, -2.0, 5.0, 6.0)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("mail a@b.co\nmail a@b.co and c@d.co\n")
    source = spark.readStream.schema("value string").text(str(tmp_path / "in"))
    redactor = Redactor(Policy({"identifiers": {"emailAddress": {}}}))
    stream = redact_stream(source, redactor, "value", "s")
    q = stream.select("filtered_text").writeStream.format("memory").queryName("redacted").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    tag = "{{{REDACTED-email-address}}}"
    assert sorted(r[0] for r in spark.table("redacted").collect()) == sorted([f"mail {tag}", f"mail {tag} and {tag}"])
    spans = stream.select(F.explode("spans").alias("s")).select("s.*")
    q = consistent_stream(spans, seed=1).writeStream.format("memory").queryName("consistent").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.token: (r.replacement, r.seen) for r in spark.table("consistent").collect()}
    assert {k: v[1] for k, v in got.items()} == {"a@b.co": 2, "c@d.co": 1} and got["a@b.co"][0] != got["c@d.co"][0]
