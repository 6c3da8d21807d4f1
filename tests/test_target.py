"""Records of a site, read and written through a server that runs beside the tests."""

import json
import os
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tabulon.operators import journal
from tabulon.sources import paged, records, sink

SF = "/root/testdata/sf0.001"


class Table:
    def __init__(self, rows):
        self.rows, self.pages, self.given, self.lock = rows, [], {}, threading.Lock()


def passes(row, field, op, value):
    have = row.get(field)
    if op == "=":
        return have == value
    if op == "!=":
        return have != value
    if op == "in":
        return have in value
    return value.strip("%").lower() in str(have).lower()


@pytest.fixture
def site():
    tables = {}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def answer(self, code, value):
            body = json.dumps(value).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            url = urllib.parse.urlparse(self.path)
            table, q = tables[urllib.parse.unquote(url.path).rpartition("/")[2]], {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
            rows = [r for r in table.rows if all(passes(r, *f) for f in json.loads(q["filters"]))]
            rows.sort(key=lambda r: r[q["order_by"].split()[0]])
            start, length = int(q["limit_start"]), int(q["limit_page_length"])
            fields = json.loads(q["fields"])
            if length > 1:
                table.pages.append((start, tuple(fields), json.loads(q["filters"])))
            self.answer(200, {"data": [{f: r.get(f) for f in fields} for r in rows[start : start + length if length else None]]})

        def do_POST(self):
            table = tables[urllib.parse.unquote(self.path).rpartition("/")[2]]
            row, once = json.loads(self.rfile.read(int(self.headers["Content-Length"]))), self.headers.get("Idempotency-Key")
            with table.lock:
                if once not in table.given:
                    if row.get("bad"):
                        return self.answer(417, {"message": f"{row['name']} is bad"})
                    table.given[once] = row["name"]
                    table.rows.append(row)
            return self.answer(200, {"data": {"name": table.given[once]}})

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield tables, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.fixture
def orders(spark, site):
    tables, url = site
    rows = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    tables["Sales Order"] = Table([r.asDict() | {"o_orderpriority": None if r["o_orderkey"] % 50 == 0 else r["o_orderpriority"]} for r in rows.collect()])
    paged.register(spark)

    def read(schema, **options):
        reader = spark.read.format("paged_records").option("url", url).option("table", "Sales Order").option("key", "o_orderkey").option("page_rows", 100).option("pages_each", 2)
        for k, v in options.items():
            reader = reader.option(k, v)
        return reader.schema(schema).load()

    local = rows.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderpriority")))
    return tables["Sales Order"], read, local


ALL = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_pages_are_partitions_and_only_named_fields_are_asked_for(orders):
    table, read, local = orders
    n = len(table.rows)
    df = read("o_orderkey long, o_orderstatus string")
    assert df.rdd.getNumPartitions() == -(-n // 200) or df.rdd.getNumPartitions() == n // 200 + 1
    table.pages.clear()
    assert same(df, local.select("o_orderkey", "o_orderstatus"))
    assert n // 100 <= len(table.pages) <= n // 100 + 2 and {p[1] for p in table.pages} == {("o_orderkey", "o_orderstatus")}


@pytest.mark.parametrize(
    "condition, pushed",
    [
        ("o_orderstatus = 'F'", [["o_orderstatus", "=", "F"]]),
        ("o_orderstatus != 'F' and o_custkey = 7", [["o_orderstatus", "!=", "F"], ["o_custkey", "=", 7]]),
        ("o_custkey in (1, 2, 3)", [["o_custkey", "in", [1, 2, 3]]]),
        ("contains(o_orderpriority, 'URG')", [["o_orderpriority", "like", "%URG%"]]),
        ("o_orderpriority != '5-LOW'", [["o_orderpriority", "!=", "5-LOW"]]),
        ("o_orderkey > 100", []),
    ],
)
def test_filters_reach_the_site(orders, condition, pushed):
    table, read, local = orders
    table.pages.clear()
    assert same(read(ALL).filter(condition), local.filter(condition))
    sent = [p[2] for p in table.pages]
    assert sent and all(sorted(map(str, s)) == sorted(map(str, pushed)) for s in sent)
    assert len(sent) <= local.filter(condition).count() // 100 + 2 if pushed else True


def test_explain_names_the_pushed_filters(orders, capsys):
    _, read, _ = orders
    read(ALL).filter("o_orderstatus = 'F' and o_custkey in (1, 2)").explain()
    plan = capsys.readouterr().out
    assert "Filter" not in plan.split("BatchScan")[0] and "o_orderstatus" in plan


def test_the_filter_grammar_and_empty_answers(orders):
    table, read, local = orders
    got = read("o_orderkey long, o_orderpriority string", filters=json.dumps([["o_orderpriority", "like", "%urgent%"]]))
    assert same(got, records.list_records(local, [("o_orderpriority", "like", "urgent")], ["o_orderkey", "o_orderpriority"]))
    assert read(ALL).filter("o_custkey = -1").count() == 0
    assert same(records.get_record(read(ALL), "o_orderkey", 3), local.filter("o_orderkey = 3"))
    with pytest.raises(LookupError):
        records.get_record(read(ALL), "o_orderkey", -3)


# ---------------------------------------------------------------- writing


def payloads(spark, n=60):
    rows = spark.range(n).select((F.col("id") + 2).alias("__row"), F.concat(F.lit("R"), F.col("id").cast("string")).alias("name"), (F.col("id") % 10 == 3).alias("bad"))
    return rows.repartition(4, "__row")


def test_a_failing_row_is_an_outcome(spark, site):
    tables, url = site
    tables["Item"] = Table([])
    existing = spark.createDataFrame([("R5",), (" R6 ",)], "name string")
    done = {r["__row"]: r for r in sink.sent_to_site(payloads(spark), "name", paged.Site(url), "Item", "run", existing).collect()}
    assert len(done) == 60 and sorted(k for k, r in done.items() if not r["ok"]) == [5, 15, 25, 35, 45, 55]
    assert "R3 is bad" in done[5]["error"] and sorted(k for k, r in done.items() if r["skipped"]) == [7, 8]
    assert sorted(r["name"] for r in tables["Item"].rows) == sorted(f"R{k}" for k in range(60) if k % 10 != 3 and k not in (5, 6))


def test_a_task_that_dies_leaves_no_second_copy(spark, site, tmp_path):
    tables, url = site
    tables["Item"] = Table([])
    mark, target = str(tmp_path / "died"), paged.Site(url)

    def send(row, once):
        name = target.insert("Item", row, once)["name"]
        if row["name"] == "R40" and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)  # the worker is gone after the target has the row and before its outcome is written
        return name

    rows = payloads(spark).drop("bad")
    with pytest.raises(Exception, match="(?i)worker|exit|EOF|failed"):
        sink.sent(rows, "name", send, "run-1")
    assert os.path.exists(mark) and 0 < len(tables["Item"].rows) <= 60
    done = sink.sent(rows, "name", send, "run-1")
    assert done.filter("ok").count() == 60 and sorted(r["name"] for r in tables["Item"].rows) == sorted(f"R{k}" for k in range(60))
    assert sink.unsent(rows, done).count() == 0


def test_rows_are_added_to_a_table_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(2, "a", 1), (3, "a", 2), (4, "", 3), (5, "b", -1), (6, "c", 4)], "__row long, k string, v int")
    first = {r["__row"]: (r["ok"], r["skipped"], r["error"]) for r in sink.stored_in(rows, "k", path, F.col("v") > 0, "no v").collect()}
    assert first == {2: (True, False, None), 3: (True, True, None), 4: (False, False, "no key"), 5: (False, False, "no v"), 6: (True, False, None)}
    again = {r["__row"]: r["skipped"] for r in sink.stored_in(rows, "k", path, F.col("v") > 0).collect()}
    assert again[2] and again[6] and sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("c", 4)]


def test_import_log(spark):
    log = [
        ("[3, 4]", "D1", True, None), ("[5]", "D2", False, '[{"message": "one"}, {"message": "two", "title": "x"}, {"title": "y"}]'), ("not json", "D3", False, "plain words"),
        ("[6]", None, True, None), ("[7]", "D5", False, None), (None, None, False, '["a"]'), ("[8]", "D6", None, "[]"), ("", "D7", False, '{"message": "z"}'),
    ]
    got = [tuple(r) for r in sink.import_outcomes(spark.createDataFrame(log, "row_indexes string, docname string, success boolean, messages string")).collect()]
    assert got == [(3, "D1", "created", None), (5, "D2", "failed", "one; two; "), (None, "D3", "failed", "plain words"), (None, "", "failed", '["a"]'), (8, "D6", "failed", ""), (None, "D7", "failed", '{"message": "z"}')]


# ---------------------------------------------------------------- logs of a folder


def test_the_latest_run_of_a_folder_of_logs(spark, tmp_path):
    for k, (name, lines) in enumerate({"run-b": ["effect"] * 3 + ["revert"], "run-a": ["effect", "requirement"], "run-c": ["requirement"]}.items()):
        path = tmp_path / f"{name}.jsonl"
        path.write_text("".join(json.dumps({"event": e, "op": "delete_record", **({"status": "ok", "reverted": 3} if e == "revert" else {})}) + "\n" for e in lines) + "broken {\n")
        os.utime(path, (1_700_000_000 + 100 * k, 1_700_000_000 + 100 * k))
    log = journal.read_runs(spark, str(tmp_path), "event string, op string, status string, reverted long")
    summary = {r["run"]: (r["effects"], r["reverted"]) for r in journal.run_summary(log).collect()}
    assert summary == {"run-b": (3, True), "run-a": (1, False), "run-c": (0, False)}
    assert journal.latest_run(journal.run_summary(log)).first()["run"] == "run-c" and journal.latest_run(journal.run_summary(log), require_effects=True).first()["run"] == "run-a"
    os.utime(tmp_path / "run-a.jsonl", (1_800_000_000, 1_800_000_000))
    log = journal.read_runs(spark, str(tmp_path), "event string, op string, status string, reverted long")
    assert journal.latest_run(journal.run_summary(log)).first()["run"] == "run-a"
    assert [r["seq"] for r in log.filter("run = 'run-b'").orderBy("seq").collect()] == sorted({r["seq"] for r in log.filter("run = 'run-b'").collect()})


def test_lines_keep_their_order_over_blocks(spark, tmp_path):
    (tmp_path / "run.jsonl").write_text("".join(f'{{"event": "effect", "n": {k}}}\n' for k in range(500)))
    names = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        log = journal.read_runs(spark, str(tmp_path), "event string, n long")
        assert log.rdd.getNumPartitions() > 3 and [r["n"] for r in log.orderBy("seq").collect()] == list(range(500))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
