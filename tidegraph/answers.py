"""Answers to requests over ranked pages, as JSON or HTML, and a small HTTP server for them.

The server is for one driver's use: each request is a query over the stored tables, whose results are limited to a few rows.
"""

from __future__ import annotations

import json
from http import HTTPStatus
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.text import escaped_html, page_link
from tidegraph.operators import search
from tidegraph.operators.storage import stored

BASE = "http://en.wikipedia.org/wiki/"


class BadRequest(ValueError):
    """A request without the parameters that it needs, or for a page that is not there."""


class Answers:
    """Ranked pages, their index of titles, and lists of categories (category, title)."""

    def __init__(self, pages: DataFrame, lists: DataFrame, shown: int = 1000):
        self.pages = pages
        self.index = stored(search.title_index(pages), "title-index")
        self.tables = stored(search.category_tables(self.index, pages, lists, shown), "category-tables")

    def things(self, query: dict[str, list[str]]) -> str:
        """Both pages named by things[], in their order."""
        names = query.get("things[]", [])
        if len(names) != 2:
            raise BadRequest("Bad search")
        asked = self.pages.sparkSession.createDataFrame(list(enumerate(names)), "place int, name string")
        found = asked.join(self.index, F.upper("name") == F.col("key"), "left").select("place", "name", "id").join(self.pages, "id", "left").orderBy("place")
        out = []
        for r in found.collect():
            if r.id is None:
                raise BadRequest(f"{r.name} doesn't exist")
            out.append({k: v for k, v in r.asDict(True).items() if k not in ("place", "name")})
        return json.dumps(out, ensure_ascii=False)

    def named_entity_suggestions(self, query: dict[str, list[str]], n: int = 10) -> str:
        """The pages behind the n best titles that begin with q."""
        prefixes = query.get("q", [])
        if len(prefixes) != 1:
            raise BadRequest("Bad search prefix")
        found = search.suggest_pages(self.index, self.pages, prefixes[0], n).drop("key")
        return json.dumps({"suggestions": [r.asDict(True) for r in found.collect()]}, ensure_ascii=False)

    def front_page(self, query: dict[str, list[str]]) -> str:
        """Tables of all categories."""
        cells = F.concat(F.lit("<tr><td>"), F.col("position").cast("string"), F.lit("</td><td>"), page_link(F.col("title"), BASE), F.lit("</td><td>"), F.format_string("%.2f", "percent_of_first"), F.lit("</td></tr>"))
        out, last = [], None
        for r in self.tables.select("category", escaped_html(F.col("category")).alias("head"), "position", cells.alias("row")).orderBy("category", "position").toLocalIterator():
            if r.category != last:
                out.append(f"{'</table>' if out else ''}<h2>{r.head}</h2><table>")
                last = r.category
            out.append(r.row)
        return "<!DOCTYPE html><html><body>" + "".join(out) + ("</table>" if out else "") + "</body></html>"

    def answer(self, target: str) -> tuple[HTTPStatus, str, str]:
        """Status, content type and body for a request target."""
        url = urlsplit(target)
        routes = {"/": (self.front_page, "text/html"), "/things": (self.things, "application/json"), "/named_entity_suggestions": (self.named_entity_suggestions, "application/json")}
        if url.path not in routes:
            return HTTPStatus.NOT_FOUND, "text/plain", "not found"
        handle, kind = routes[url.path]
        try:
            return HTTPStatus.OK, kind, handle(parse_qs(url.query))
        except BadRequest as e:
            return HTTPStatus.BAD_REQUEST, "text/plain", str(e)


def server(answers: Answers, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, kind, body = answers.answer(self.path)
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def serve(answers: Answers, port: int) -> None:
    with server(answers, port) as s:
        s.serve_forever()
