import bz2
import datetime
import gzip
import json

import pytest
from lodeframe.engine import Engine
from lodeframe.errors import CatalogError, IngestError
from lodeframe.server import respond
from lodeframe.sources.sniff import clean, clean_all, sniff


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path))


def kinds(m):
    return [(c["dtype"], c["nullable"]) for c in m["schema"]]


@pytest.mark.parametrize(("raw", "delimiter"), [(b"a,b\n1,2\n", ","), (b"a;b\n1;2\n", ";"), (b"a\tb\n1\t2\n", "\t"), (b"a|b\n1|2\n", "|"), (b"a b\n1 2\n", " "), (b"a\n1\n", ",")])
def test_sniffing(raw, delimiter):
    for packed in (raw, gzip.compress(raw), bz2.compress(raw), b"\xef\xbb\xbf" + raw):
        assert sniff(packed).delimiter == delimiter


def test_names():
    assert [clean(x) for x in (" fooBar ", "a--b", "1st", "ÄÖ", "A_b_")] == ["foo_bar", "a_b", "column_1st", "column", "a_b"]
    assert clean_all(["a", "A", "", "b"]) == ["a_01", "a_02", "column_01", "b"]


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress, bz2.compress, lambda x: b"\xef\xbb\xbf" + x, lambda x: gzip.compress(b"\xef\xbb\xbf" + x)])
def test_types(engine, pack):
    text = "s,i,f,b,d,t,n,mix,q\nx,+1,1.5,t,2020-02-29,2020-01-01 10:00:00,,1,\"a,\n\"\"b\"\"\"\n,,,,,,,,\ny,-2,nan,FALSE,2020-01-01,2020-01-01T10:00:00.789,,x,\" c \"\n"
    m = engine.catalog.load(pack(text.encode()), "types")
    assert kinds(m) == [("string", True), ("int", True), ("float", True), ("bool", True), ("date", True), ("datetime", True), ("null", True), ("string", True), ("string", True)]
    rows = [tuple(r) for r in engine.sql("SELECT * FROM types ORDER BY s").collect()]
    assert rows[1] == ("x", 1, 1.5, True, datetime.date(2020, 2, 29), datetime.datetime(2020, 1, 1, 10), None, "1", 'a,\n"b"')
    assert rows[0] == ("", None, None, None, None, None, None, "", "")
    assert rows[2][5] == datetime.datetime(2020, 1, 1, 10, 0, 0, 789000) and rows[2][2] is None and rows[2][8] == " c "


def test_tabs_are_not_quoted(engine):
    engine.catalog.load(b'a\tb\n"x\t1\n', "tabs")
    assert engine.sql("SELECT a, b FROM tabs").collect() == [('"x', 1)]


def test_bad_files(engine):
    for raw in (b"", b"a,b\n"):
        with pytest.raises(IngestError):
            engine.catalog.load(raw, "x")
    with pytest.raises(Exception, match="another width"):
        engine.catalog.load(b"a,b\n1,2\n1,2,3\n", "x")
    with pytest.raises(IngestError):
        engine.catalog.load_map("x", {"a": ["1"], "b": []})


def test_versions(engine, spark):
    one = engine.catalog.load_map("T", {"a": ["1", "2"]})
    engine.catalog.load_map("t", {"a": ["x"]})
    assert engine.sql("SELECT a FROM t").collect() == [("x",)]
    assert engine.sql(f"SELECT count() AS n FROM t@v{one['id']}").collect() == [(2,)]
    again = Engine(spark, str(engine.catalog.folder))
    assert [m["nrows"] for m in again.catalog.list()] == [2, 1]
    again.catalog.remove("t")
    assert again.sql("SELECT a FROM t ORDER BY a").collect() == [(1,), (2,)]
    with pytest.raises(CatalogError):
        again.sql("SELECT a FROM nothing")


def test_http(engine):
    ask = lambda method, path, body=b"": respond(engine, method, path, body)
    assert ask("GET", "/status") == (200, b'{"status": "ok"}')
    assert ask("POST", "/upload/auto?name=up", b"a,b\n1,x\n,y\n")[0] == 200
    assert [d["name"] for d in json.loads(ask("GET", "/api/datasets")[1])] == ["up"]
    status, out = ask("POST", "/api/query", b'{"sql": "SELECT a, b FROM up ORDER BY b DESC"}')
    assert status == 200 and json.loads(out) == {"schema": [{"name": "a", "dtype": "int", "nullable": True}, {"name": "b", "dtype": "string", "nullable": True}], "nrows": 2, "bytes_read": 0, "ordering": [None, "desc"], "data": [[None, "y"], [1, "x"]]}
    assert [ask("GET", "/api/query")[0], ask("POST", "/api/query", b'{"x": 1}')[0], ask("POST", "/api/query", b'{"sql": "nope"}')[0], ask("GET", "/no")[0]] == [405, 400, 500, 404]
    assert json.loads(ask("POST", "/upload/raw?name=r", b"zz")[1])["size_raw"] == 2


def test_a_row_like_the_header_is_data(engine):
    for raw in (b"a\tb\n1\tx\na\tb\n2\ty\n", b"a,b\n1,x\na,b\n2,y\n"):
        assert engine.catalog.load(raw, "again")["nrows"] == 3
        assert [r.b for r in engine.sql("SELECT a, b FROM again ORDER BY b").collect()] == ["b", "x", "y"]


def test_bzip2_blocks_longer_than_a_sample(engine):
    import random

    r = random.Random(1)
    packed = bz2.compress(("n,text\n" + "".join(f"{i},{r.randbytes(30).hex()}\n" for i in range(30_000))).encode())
    assert len(packed) > 900_000
    m = engine.catalog.load(packed, "long")
    assert (m["nrows"], kinds(m)) == (30_000, [("int", False), ("string", False)])


def test_line_ends_in_quotes_are_found(engine, spark, tmp_path):
    from lodeframe.sources.ingest import quoted_lines

    for raw, whole in (("a,b\n1,\"x\ny\"\n", True), ('a,b\n1,"x ""y"" z"\n', False), ("a,b\n", False)):
        (tmp_path / "q.csv").write_text(raw)
        assert quoted_lines(spark, str(tmp_path / "q.csv")) is whole


def test_schema_folder_and_files(engine, spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.DoubleType())])
    m = engine.catalog.load(b"a,b\n1,2\n,\n", "given", schema)
    assert kinds(m) == [("string", True), ("float", True)] and engine.sql("SELECT a, b FROM given ORDER BY a").collect() == [("", None), ("1", 2.0)]
    with pytest.raises(IngestError):
        engine.catalog.load(b"a,c\n1,2\n", "given", schema)
    folder = tmp_path / "folder"
    (folder / "more").mkdir(parents=True)
    (folder / "one.two.csv").write_text("x\n1\n")
    (folder / "three.csv.gz").write_bytes(gzip.compress(b"y|z\n1|2\n"))
    assert [m["name"] for m in engine.catalog.load_folder(str(folder))] == ["one_two", "three_csv"]
    engine.catalog.drop()
    assert engine.catalog.list() == []


def test_damaged_pages_are_noticed(engine, spark):
    df = spark.range(1000).selectExpr("md5(cast(id as string)) as h").coalesce(1)
    m = engine.catalog.add("damaged", df)
    assert engine.sql("SELECT count(h) AS n FROM damaged").collect() == [(1000,)]
    path = f"{engine.catalog.folder}/data/{m['id']}/{m['stripes'][0]}"
    raw = bytearray(open(path, "rb").read())
    raw[len(raw) // 2] ^= 1
    open(path, "wb").write(raw)
    crc = path.replace("part-", ".part-") + ".crc"
    __import__("os").remove(crc)  # the file system's own checksum would notice first
    with pytest.raises(Exception, match="(?i)checksum|corrupt"):
        engine.sql("SELECT max(h) AS n FROM damaged").collect()


def test_remote_files_are_http_only(engine, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Page(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"a;b\n1;x\n")

        def log_message(self, *args):
            pass

    page = HTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=page.handle_request, daemon=True).start()
    ask = lambda **x: respond(engine, "POST", "/upload/remote", json.dumps(x).encode())
    status, out = ask(name="far", url=f"http://127.0.0.1:{page.server_port}/x.csv")
    assert status == 200 and json.loads(out)["nrows"] == 1 and engine.sql("SELECT b FROM far").collect() == [("x",)]
    (tmp_path / "secret.csv").write_text("a\n1\n")
    for url in (f"file://{tmp_path}/secret.csv", f"{tmp_path}/secret.csv", "ftp://x/y", "s3://b/k"):
        assert ask(name="x", url=url)[0] == 500 and [m["name"] for m in engine.catalog.list()] == ["far"]
    assert [ask(name="x")[0], ask(url="http://x")[0], ask(name="", url="")[0], ask(name="x", url=1)[0]] == [400] * 4


def test_server_arguments_and_samples(engine, tmp_path):
    from lodeframe.server import arguments, load_samples

    got = arguments(["--expose", "--port-http", "9000", "--wdir", "/shared/x", "--samples", "s"])
    assert (got.expose, got.port_http, got.wdir, got.samples) == (True, 9000, "/shared/x", "s")
    folder = tmp_path / "s"
    folder.mkdir()
    (folder / "a.csv").write_text("x\n1\n")
    assert [len(load_samples(engine, str(folder))) for _ in range(2)] == [1, 0]


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from lodeframe.sources.catalog import Catalog

    c = Catalog(spark)
    c.spark = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(CatalogError):
        c.folder  # noqa: B018


def test_upload_client(engine, tmp_path, capsys, monkeypatch):
    import io
    import threading
    from types import SimpleNamespace

    from lodeframe import ingest_cli
    from lodeframe.server import serve

    server = serve(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "first.csv").write_text("a\n1\n")
    (tmp_path / "second.csv").write_text("a\nx\n")
    monkeypatch.setattr(ingest_cli.sys, "stdin", SimpleNamespace(buffer=io.BytesIO(b"b\n2.5\n")))
    port = str(server.server_address[1])
    ingest_cli.main(["--port", port, str(tmp_path / "up"), str(tmp_path / "second.csv")])
    ingest_cli.main(["--port", port])
    server.shutdown()
    assert [m["name"] for m in engine.catalog.list()] == ["first", "second", "standard_input_data"]
    assert [json.loads(x)["nrows"] for x in capsys.readouterr().out.splitlines()] == [1, 1, 1]
