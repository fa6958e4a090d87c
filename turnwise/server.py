"""Transcript jobs over HTTP, with the standard library alone; an adapter around a pluggable attribution function.

POST /jobs?filename=NAME (the body is the file): 202, 415 for other types, 400 for an empty body. GET /jobs/ID, GET
/jobs/ID/srt (409 until done), GET /jobs/ID/stream (one JSON line a segment, those there are and then those to come, and a
last line with the status), GET /healthz. A failure is told by its job; the uploaded file is always removed.
"""

from __future__ import annotations

import json
import os
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from turnwise.streaming.jobs import SUFFIXES

Stream = Callable[[str], Iterable[dict]]


def stamp(seconds: float) -> str:
    ms = int(round(max(seconds, 0.0) * 1000))
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"


def srt(segments: list[dict]) -> str:
    return "\n\n".join(f"{i}\n{stamp(s['start'])} --> {stamp(s['end'])}\n{s['speaker'] + ': ' if s.get('speaker') else ''}{s['text']}" for i, s in enumerate(segments, 1)) + "\n"


class Jobs:
    """Jobs run one after the other; their segments can be read while they run.

    Uploads lie in ``folder`` while they are worked on: on a cluster it must be one that executors see.
    """

    def __init__(self, stream: Stream, folder: str | None = None) -> None:
        self.stream, self.folder, self.jobs, self.lock, self.pool = stream, folder, {}, threading.Lock(), ThreadPoolExecutor(1)

    def submit(self, filename: str, data: bytes) -> tuple[int, dict]:
        suffix = os.path.splitext(filename)[1].lower()
        if suffix not in SUFFIXES:
            return 415, {"detail": f"no audio by its name: {suffix or '(none)'}", "accepted": list(SUFFIXES)}
        if not data:
            return 400, {"detail": "the file has no bytes"}
        name = uuid.uuid4().hex[:12]
        self._tell(name, id=name, filename=filename, status="queued", segments=[], error=None)
        self.pool.submit(self._work, name, suffix, data)
        return 202, {"id": name, "status": "queued"}

    def _tell(self, name: str, **news: object) -> None:
        with self.lock:
            self.jobs.setdefault(name, {}).update(news)

    def _work(self, name: str, suffix: str, data: bytes) -> None:
        self._tell(name, status="running")
        with tempfile.NamedTemporaryFile(suffix=suffix, dir=self.folder) as upload:
            upload.write(data)
            upload.flush()
            try:
                for segment in self.stream(upload.name):
                    with self.lock:
                        self.jobs[name]["segments"].append(segment)
            except Exception as e:  # its job tells it, others go on
                return self._tell(name, status="error", error=f"{type(e).__name__}: {e}")
        return self._tell(name, status="done")

    def response(self, job: dict) -> dict:
        with self.lock:
            out = {"id": job["id"], "filename": job["filename"], "status": job["status"]}
            return out | ({"error": job["error"]} if job["status"] == "error" else {"segments": list(job["segments"])} if job["status"] in ("running", "done") else {})

    def follow(self, job: dict, poll: float = 0.05) -> Iterable[dict]:
        """The job's segments, those to come included, then its status."""
        sent = 0
        while True:
            over = job["status"] in ("done", "error")
            with self.lock:
                new = job["segments"][sent:]
            yield from ({"type": "segment", **s} for s in new)
            sent += len(new)
            if over and not new:
                yield {"type": "status", "status": job["status"]} | ({"error": job["error"]} if job["error"] else {})
                return
            time.sleep(0 if new else poll)


def create_server(stream: Stream, port: int = 0, host: str = "127.0.0.1", folder: str | None = None) -> ThreadingHTTPServer:
    jobs = Jobs(stream, folder)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_: object) -> None:
            pass

        def reply(self, code: int, body: dict | str, kind: str = "application/json") -> None:
            data = (json.dumps(body, ensure_ascii=False) if isinstance(body, dict) else body).encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self) -> None:
            url = urlsplit(self.path)
            data = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if url.path != "/jobs":
                return self.reply(404, {"detail": "not found"})
            return self.reply(*jobs.submit(parse_qs(url.query).get("filename", ["upload"])[0], data))

        def do_GET(self) -> None:
            parts = urlsplit(self.path).path.strip("/").split("/")
            if parts == ["healthz"]:
                return self.reply(200, {"status": "ok"})
            job = jobs.jobs.get(parts[1]) if len(parts) in (2, 3) and parts[0] == "jobs" else None
            if job is None:
                return self.reply(404, {"detail": "unknown job"})
            if len(parts) == 2:
                return self.reply(200, jobs.response(job))
            if parts[2] == "srt":
                return self.reply(200, srt(job["segments"]), "text/plain; charset=utf-8") if job["status"] == "done" else self.reply(409, {"detail": f"no subtitles while {job['status']}"})
            if parts[2] != "stream":
                return self.reply(404, {"detail": "not found"})
            self.send_response(200)
            self.send_header("Content-Type", "application/x-ndjson")
            self.end_headers()
            for line in jobs.follow(job):
                self.wfile.write((json.dumps(line, ensure_ascii=False) + "\n").encode())
                self.wfile.flush()

    return ThreadingHTTPServer((host, port), Handler)


def spark_stream(spark, vad, embed, asr) -> Stream:
    """Attribution of one file by the batch plan, as a stream of segments."""
    from turnwise.plans.attribute import attribute
    from turnwise.sources.audio import read_audio

    def run(path: str) -> Iterable[dict]:
        for r in attribute(read_audio(spark, path), vad, embed, asr).orderBy("seg_idx").toLocalIterator():
            yield {"start": r.start, "end": r.end, "speaker": r.speaker, "text": r.text}

    return run
