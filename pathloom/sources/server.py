"""A small HTTP look-up of graph positions: ``GET /<path>/<position>``, both from 1."""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import unquote

from pyspark.sql import functions as F

from pathloom.operators.ranges import pangenome_position
from pathloom.plans.graph import Graph


def look_up(g: Graph, path_name: str, position: int) -> int:
    """The graph position of a path position, 0 where there is none."""
    at = g.paths.where(F.col("path_name") == path_name).select("path_id", F.lit(position).cast("long").alias("offset"))
    row = pangenome_position(g, at).head()
    return int(row.pan_position) if row else 0


def server(g: Graph, host: str = "127.0.0.1", port: int = 8080) -> HTTPServer:
    """A server for one graph; ``/hi`` answers, ``/stop`` ends it.  Call ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            name, _, number = unquote(self.path).lstrip("/").rpartition("/")
            text = "Hello World!" if self.path == "/hi" else "bye" if self.path == "/stop" else str(look_up(g, name, int(number))) if number.isdigit() else "0"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(text.encode())
            if self.path == "/stop":
                self.server.stopped = True

        def log_message(self, *_: object) -> None:
            pass

    return HTTPServer((host, port), Handler)
