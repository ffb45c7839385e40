import pytest

from strataloom.functions import udfs
from strataloom.functions.endpoints import endpoints
from strataloom.sources.files import scan
from strataloom.sources.store import Conflict, Store


def test_generations_are_swapped_whole(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    first = store.commit({"nodes": spark.range(3), "edges": spark.range(5)}, store.manifest())
    assert first["generation"] == 1 and store.commit({}, first) == first
    second = store.commit({"nodes": spark.range(4)}, first)
    assert store.read("nodes").count() == 4 and store.read("nodes", first).count() == 3 and store.read("edges", second).count() == 5
    with pytest.raises(Conflict):
        store.commit({"nodes": spark.range(1)}, first)
    bad = spark.range(3).selectExpr("raise_error('x') as x")
    with pytest.raises(Exception, match="x"):
        store.commit({"nodes": bad}, second)
    assert store.stale() and store.read("nodes").count() == 4
    store.append("events", spark.range(2))
    store.append("events", spark.range(2))
    assert store.log("events").count() == 4
    assert store.collect_garbage() >= 1 and store.read("nodes").count() == 4


def test_text_functions(spark):
    df = spark.createDataFrame([("é", '{"b":1,"a":[2]}'), (None, "x")], "t string, j string")
    got = df.select(udfs.nfc("t").alias("n"), udfs.fold_diacritics("t").alias("f"), udfs.canonical_json("j").alias("c")).collect()
    assert tuple(got[0]) == ("é", "e", '{"a":[2],"b":1}') and tuple(got[1]) == (None, None, None)


def test_extraction(spark):
    py = "import os\nclass A(base.B):\n    def m(self):\n        # app.get('/no')\n        return os.getcwd()\n@app.get('/users')\ndef f():\n    requests.post('/x')\n"
    js = "// fetch('/no')\nfetch('/users'); queue.publish(\"t.a\"); rpc.call('s.m')"
    df = spark.createDataFrame([("a.py", "python", py), ("b.js", "javascript", js), ("c.py", "python", "def (")], "path string, language string, content string")
    facts = {(r.fact, r.name, r.qualified) for r in udfs.extract(df, "facts").collect()}
    assert {("class", "A", "A"), ("extends", "base.B", "A"), ("method", "m", "A.m"), ("call", "os.getcwd", "A.m"), ("import", "os", ""), ("function", "f", "f")} <= facts
    ends = {(r.path, r.protocol, r.role, r.resource) for r in udfs.extract(df, "endpoints").collect()}
    assert ends == {("a.py", "http", "server", "/users"), ("a.py", "http", "client", "/x"), ("b.js", "http", "client", "/users"), ("b.js", "queue", "producer", "t.a"), ("b.js", "rpc", "client", "s.m")}


def ends(language, source):
    return [e[:5] for e in endpoints(source, language)]


def test_only_code_has_endpoints():
    assert ends("python", '\'\'\'app.get("/a")\'\'\'\nx = "requests.get(\'/b\')"  # requests.get("/c")\n') == []
    assert ends("javascript", "const s = \"app.get('/doc', h)\"; /* fetch('/no') */ `fetch('/no')`") == []


def test_scripts():
    got = ends("typescript", "app.get('/users', listUsers);\nfetch('/x', {headers: {a: f(1)}, method: 'POST'});\nfetch('/y')\naxios.put(\"/z\", body)\nrouter.get('/inline', () => 1)")
    assert got == [("http", "server", "get", "/users", "listUsers"), ("http", "client", "post", "/x", None), ("http", "client", "get", "/y", None), ("http", "client", "put", "/z", None)]
    got = ends("javascript", "rpc.register('a.b', handle)\nqueue.subscribe('t', on)\nqueue.on('t')\ndb.query(`select * from\n users where 1`)\ndb.run('delete from a.b'); db.run('select 1; select 2')")
    assert got == [("rpc", "server", "handle", "a.b", "handle"), ("queue", "consumer", "consume", "t", "on"), ("database", "reader", "read", "users", None), ("database", "writer", "delete", "a.b", None)]


def test_python_decorators(spark):
    source = "@app.route('/r', methods=['GET', 'POST'])\nasync def both():\n    httpx.get('/up')\n@queue.consumer('jobs')\ndef work(): pass\n@rpc.method('m')\ndef m(): pass\n@app.route('/any')\ndef any_(): pass\n"
    df = spark.createDataFrame([("a.py", "python", source)], "path string, language string, content string")
    got = {tuple(r)[1:6] for r in udfs.extract(df, "endpoints").collect()}
    assert got == {("http", "server", m, "/r", "both") for m in ("get", "post")} | {("http", "client", "get", "/up", "both"), ("queue", "consumer", "consume", "jobs", "work"), ("rpc", "server", "handle", "m", "m"), ("http", "server", "any", "/any", "any_")}


def test_go_and_rust():
    go = 'http.HandleFunc("/h", serve)\nhttp.Get("/g")\nhttp.NewRequest("PATCH", "/p", nil)\n// http.Get("/no")'
    assert ends("go", go) == [("http", "server", "any", "/h", "serve"), ("http", "client", "get", "/g", None), ("http", "client", "patch", "/p", None)]
    rust = "fn f<'a>(x: &'a str) {}\nRouter::new().route(\"/r\", post(make))\n#[get(\"/a\")]\npub async fn act() {}\nreqwest::get(\"/up\")\nsqlx::query(\"insert into t values (1)\")"
    assert ends("rust", rust) == [("http", "server", "post", "/r", "make"), ("http", "server", "get", "/a", "act"), ("http", "client", "get", "/up", None), ("database", "writer", "insert", "t", None)]


def test_one_writer_and_pins(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    first = store.commit({"nodes": spark.range(3)}, store.manifest())
    with store.pinned() as seen:
        second = store.commit({"nodes": spark.range(4)}, first)
        assert seen == first and store.collect_garbage() == 0 and store.read("nodes", seen).count() == 3
        held = store._lease()
        with pytest.raises(Conflict):
            store.commit({"nodes": spark.range(9)}, second)
        store.lease = -1  # the writer that held it is gone
        third = store.commit({"nodes": spark.range(5)}, second)
        assert held is not None and third["generation"] == 3
    assert store.collect_garbage() == 2 and store.read("nodes").count() == 5


@pytest.mark.parametrize("step", ["create", "rename", "mkdirs"])
def test_a_crash_before_any_step_keeps_what_was(spark, tmp_path, monkeypatch, step):
    store = Store(spark, f"file://{tmp_path}/store", lease=0)
    first = store.commit({"nodes": spark.range(3)}, store.manifest())
    real = store._fs()

    class Dies:
        def __getattr__(self, name):
            if name == step:
                raise KeyboardInterrupt
            return getattr(real, name)

    monkeypatch.setattr(store, "_fs", Dies)
    with pytest.raises(KeyboardInterrupt):
        store.commit({"nodes": spark.range(4)}, first)
    monkeypatch.undo()
    assert store.manifest() == first and store.read("nodes").count() == 3
    assert store.commit({"nodes": spark.range(5)}, first)["generation"] == 2 and store.read("nodes").count() == 5


def test_secrets_and_odd_roots(spark, tmp_path):
    root = tmp_path / "a+b(x)"
    for name in ("x.py", ".env.py", "secrets/a.py", "credentials.py", "my.secret.py", "k.pem"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("1")
    assert sorted(r.path for r in scan(spark, f"file://{root}").collect()) == ["my.secret.py", "x.py"]
