import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from turnwise import server


@pytest.fixture
def base():
    def stream(path):
        data = open(path, "rb").read()
        if data == b"bad":
            raise RuntimeError("no speech")
        for i in range(3):
            time.sleep(0.02)
            yield {"start": float(i), "end": i + 0.5, "speaker": "A" if i else None, "text": f"t{i}"}

    s = server.create_server(stream)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def call(url, data=None):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, method="GET" if data is None else "POST"), timeout=10) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode()


def wait(base, job):
    for _ in range(200):
        got = json.loads(call(f"{base}/jobs/{job}")[1])
        if got["status"] in ("done", "error"):
            return got
        time.sleep(0.02)
    raise AssertionError("not done")


def test_jobs_over_http(base):
    assert call(f"{base}/healthz") == (200, '{"status": "ok"}')
    code, body = call(f"{base}/jobs?filename=a.WAV", b"x")
    job = json.loads(body)["id"]
    assert code == 202 and len(job) == 12
    lines = [json.loads(x) for x in call(f"{base}/jobs/{job}/stream")[1].splitlines()]
    assert [x["type"] for x in lines] == ["segment"] * 3 + ["status"] and lines[-1]["status"] == "done"
    assert [json.loads(x) for x in call(f"{base}/jobs/{job}/stream")[1].splitlines()] == lines
    assert len(wait(base, job)["segments"]) == 3
    assert call(f"{base}/jobs/{job}/srt")[1].startswith("1\n00:00:00,000 --> 00:00:00,500\nt0\n\n2\n00:00:01,000 --> 00:00:01,500\nA: t1")


def test_refusals_and_failures(base):
    assert call(f"{base}/jobs?filename=a.txt", b"x")[0] == 415 and call(f"{base}/jobs?filename=a.wav", b"")[0] == 400
    assert call(f"{base}/jobs/none")[0] == 404 and call(f"{base}/jobs/none/srt")[0] == 404
    job = json.loads(call(f"{base}/jobs?filename=a.wav", b"bad")[1])["id"]
    got = wait(base, job)
    assert got["error"] == "RuntimeError: no speech" and "segments" not in got and call(f"{base}/jobs/{job}/srt")[0] == 409
