"""A thin socket front end over one engine or replica: threads hand commands to Spark's own scheduler.

python -m tessera.server --port 7000 --data DIR [--threads N] [--idle SECONDS]
    [--primary-data DIR [--primary HOST:PORT]]     a replica of the primary with that folder; writes go to its server
    [--cluster FILE --shard N]                     the N-th (from 0) line of the file, which has each server's key range
"""

from __future__ import annotations

import argparse
import socketserver
import threading
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from tessera.cluster import Remote, Router
from tessera.engine import Engine
from tessera.operators.shards import parse_config
from tessera.plans.lexer import CommandError
from tessera.sources import wire
from tessera.streaming.replica import Replica


def reply(target, text: str) -> str:
    try:
        return target.exec(text)
    except CommandError as e:
        return f"ERROR: {e}"
    except Exception as e:  # a client gets the reason, the server goes on
        return f"ERROR: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"


class Server(socketserver.TCPServer):
    allow_reuse_address = True
    request_queue_size = 256

    def __init__(self, address: tuple[str, int], target, threads: int = 64):
        self.target, self.pool = target, ThreadPoolExecutor(threads)
        super().__init__(address, _Handler)

    def process_request(self, request, client_address) -> None:
        self.pool.submit(self._serve, request, client_address)

    def _serve(self, request, client_address) -> None:
        try:
            self.finish_request(request, client_address)
        finally:
            self.shutdown_request(request)

    def server_close(self) -> None:
        super().server_close()
        self.pool.shutdown(wait=False, cancel_futures=True)


class _Handler(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        while (text := wire.receive(self.rfile)) is not None:
            if text.strip().lower() in ("exit", "quit"):
                wire.send(self.wfile, "BYE")
                return
            wire.send(self.wfile, reply(self.server.target, text))


def compact_when_idle(engine: Engine, idle: float = 30, rest: float = 300, stop: threading.Event | None = None) -> threading.Thread:
    """Compact all tables after ``idle`` seconds without a request, and then not for ``rest`` seconds."""
    stop = stop or threading.Event()

    def loop() -> None:
        quiet = time.monotonic()
        while not stop.wait(min(1.0, idle / 2)):
            if engine.inflight:
                quiet = time.monotonic()
            elif time.monotonic() - quiet >= idle:
                engine.compact_all()
                quiet = time.monotonic() + rest

    t = threading.Thread(target=loop, daemon=True)
    t.start()
    return t


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--port", type=int, default=7000)
    p.add_argument("--data", default="data")
    p.add_argument("--threads", type=int, default=64)
    p.add_argument("--primary-data", help="a primary's folder: serve as its replica")
    p.add_argument("--primary", help="HOST:PORT of the primary's server, for writes")
    p.add_argument("--cluster", help="a file with a line for each server: host, port, lowest key and key after the last in hex, - for none")
    p.add_argument("--shard", type=int, help="the line that is this server, from 0 in order of keys")
    p.add_argument("--idle", type=float, default=0, help="compact after so many idle seconds")
    p.add_argument("--chains", action="store_true", help="show heavy paths passed with QUERY")
    a = p.parse_args()
    spark = SparkSession.builder.appName("tessera").config("spark.scheduler.mode", "FAIR").getOrCreate()
    if a.primary_data:
        host, _, port = (a.primary or "").rpartition(":")
        target = Replica(spark, a.data, a.primary_data, Remote(host, int(port)) if a.primary else None)
        target.start()
    else:
        target = Engine(spark, a.data, show_chains=a.chains)
        if a.idle:
            compact_when_idle(target, a.idle)
        if a.cluster:
            with open(a.cluster) as f:
                target = Router(target, parse_config(f.read()), a.shard)
    with Server(("0.0.0.0", a.port), target, a.threads) as server:
        server.serve_forever()


if __name__ == "__main__":
    main()
