import json
import threading
import urllib.error
import urllib.request

import pytest
from concordat import cli, run
from concordat.server import http, jobs


def test_jobs(tmp_path):
    store = jobs.JobStore(str(tmp_path / "jobs.sqlite"))
    manager = jobs.JobManager(store)
    key, done = manager.submit("double", 21, lambda x, tell: tell(0.5, "half") or x * 2)
    done.result()
    assert store.get(key)["result"] == 42 and store.get(key)["progress"] == 1.0
    failed, done = manager.submit("fail", None, lambda x, tell: 1 / 0)
    done.result()
    assert store.get(failed)["status"] == "failed" and "ZeroDivisionError" in store.get(failed)["error"]
    with pytest.raises(ValueError):
        store.update(key, "running")
    waiting = store.create("late", {})
    assert jobs.JobStore(str(tmp_path / "jobs.sqlite")).get(waiting)["status"] == "interrupted"


def test_http(spark, tmp_path):
    run.run(spark, cli.demo(str(tmp_path / "demo")), str(tmp_path / "out"))
    server = http.server(http.Results(spark, str(tmp_path / "out")), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}/api"
    get = lambda path: json.load(urllib.request.urlopen(base + path))
    try:
        assert get("/health")["n_entities"] == 9
        page = get("/genes?q=a&limit=2&sort=quality_score&order=desc")
        assert len(page["items"]) == 2 and page["total"] > 2
        assert len(get("/genes/ca9")) == 3 and get("/studies")["total"] == len(get("/studies")["items"]) == 4
        for path, code in (("/genes?limit=9999", 400), ("/genes/none", 404), ("/nothing", 404)):
            with pytest.raises(urllib.error.HTTPError) as problem:
                get(path)
            assert problem.value.code == code
    finally:
        server.shutdown()
