"""Scan of chat-export pages: messages, service rows and elements that could not be read.

One event-driven pass over the markup: a stack of open elements says where text belongs, so a
page is read in linear time, whatever its nesting. Each worker holds one page; pages are bounded by the exporter.
Rows keep their place on the page; the sender is the printed one (see operators.messages for the carry).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairstone.workers import importable

#: The exporter's folders and the kinds of media in them, and its texts for media that were not exported.
FOLDERS = {"photos": "PHOTO", "files": "DOCUMENT", "video_files": "VIDEO", "voice_messages": "VOICE", "round_video_messages": "ROUND_VIDEO", "stickers": "STICKER", "animations": "ANIMATION", "audio_files": "AUDIO"}
ABSENT = ("Not included, change data exporting settings to download.", "Exceeds maximum size, change data exporting settings to download.")
_VOID = frozenset(("br", "img", "meta", "link", "input", "hr"))
_ID = re.compile(r"message(-?[0-9]+)")
_TARGET = re.compile(r"(?:([^#/]+\.html))?#go_to_message([0-9]+)")
_CALL = re.compile(r"GoToMessage\(([0-9]+)\)")

_MEDIA = "array<struct<href:string,thumbnail:string,kind:string,title:string,absence:string>>"
SCHEMA = f"""page_id long, place int, row_kind string, dom_id string, message_id long, is_joined boolean, sender string, sent_raw string, text string,
 reply_to long, reply_file string, forwarded_from string, forwarded_raw string, media {_MEDIA}, contacts array<struct<kind:string,value:string>>"""


class _Export(HTMLParser):
    """Collects one dict for each message element. `inside` holds (tag, role) of the open elements; a role names where text goes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.inside: list[tuple[str, str]] = []
        self.row: dict | None = None

    def _role(self, classes: set[str], attrs: dict) -> str:
        if "message" in classes:
            return "message"
        if self.row is None:
            return ""
        if {"forwarded", "body"} <= classes:
            return "forwarded"
        for name in ("from_name", "text", "reply_to", "media_wrap", "title", "description", "body"):
            if name in classes:
                return name
        if "media" in classes:
            return "media"
        return "date" if "date" in classes and attrs.get("title") else ""

    def handle_starttag(self, tag: str, attrs_: list) -> None:
        attrs = dict(attrs_)
        classes = set((attrs.get("class") or "").split())
        role = self._role(classes, attrs) if tag in ("div", "span") else ""
        within = {r for _, r in self.inside}
        if role == "message":
            self.row = {"dom_id": attrs.get("id") or "", "classes": classes, "parts": {}, "media": [], "contacts": [], "blocks": []}
            self.rows.append(self.row)
        elif self.row is not None:
            if role == "date":
                self.row.setdefault("forwarded_raw" if "forwarded" in within else "sent_raw", attrs["title"])
            elif role == "media":
                kind = next((c[6:].upper() for c in sorted(classes) if c.startswith("media_") and c != "media_wrap"), "UNKNOWN")
                self.row["blocks"].append({"kind": kind, "title": [], "description": []})
            elif role == "media_wrap":
                self.row["wrapped"] = True
            if tag == "a" and attrs.get("href"):
                self._link(attrs, within, classes)
            elif tag == "img" and "media_wrap" in within and self.row["media"]:
                self.row["media"][-1]["thumbnail"] = attrs.get("src")
            elif tag == "br" and "text" in within:
                self.handle_data("\n")
        if tag not in _VOID:
            self.inside.append((tag, role))

    def _link(self, attrs: dict, within: set[str], classes: set[str]) -> None:
        href, row = attrs["href"].strip(), self.row
        if "media_wrap" in within:
            own = next((c[6:].upper() for c in sorted(classes) if c.startswith("media_")), "UNKNOWN")
            row["media"].append({"href": href, "thumbnail": None, "kind": FOLDERS.get(href.split("/")[0], own), "title": None, "absence": None})
        elif "reply_to" in within:
            found, call = _TARGET.fullmatch(href), _CALL.search(attrs.get("onclick") or "")
            if found:
                row["reply"] = (int(found.group(2)), found.group(1))
            elif call:
                row["reply"] = (int(call.group(1)), None)
        elif "text" in within:
            kind, value = ("PHONE", href[4:].replace(" ", "")) if href.startswith("tel:") else ("USERNAME", href.split("t.me/", 1)[1].strip("/")) if "t.me/" in href else ("LINK", href) if href.startswith(("http://", "https://")) else ("", "")
            if value and {"kind": kind, "value": value} not in row["contacts"]:
                row["contacts"].append({"kind": kind, "value": value})

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.inside) - 1, -1, -1):  # an element that was never closed ends with the one around it
            if self.inside[at][0] == tag:
                if any(r == "message" for _, r in self.inside[at:]):
                    self.row = None
                del self.inside[at:]
                return

    def handle_data(self, data: str) -> None:
        if self.row is None:
            return
        roles = [r for _, r in self.inside if r]
        last = roles[-1]
        if last in ("title", "description") and self.row["blocks"]:
            self.row["blocks"][-1][last].append(data)
        elif last in ("from_name", "text", "body"):
            name = "forwarded_from" if last == "from_name" and "forwarded" in roles else last
            self.row["parts"].setdefault(name, []).append(data)


def parse(html: str | None) -> list[dict]:
    """The rows of one page, in order; broken markup gives what could be read."""
    reader = _Export()
    reader.feed(html or "")
    reader.close()
    out = []
    for place, row in enumerate(reader.rows):
        found = _ID.fullmatch(row["dom_id"])
        number = int(found.group(1)) if found else None
        service = "service" in row["classes"]
        text = {k: "".join(v).strip() or None for k, v in row["parts"].items()}
        media = row["media"] or [
            {"href": None, "thumbnail": None, "kind": b["kind"], "title": "".join(b["title"]).strip() or None, "absence": reason if (reason := "".join(b["description"]).strip()) in ABSENT else None}
            for b in row["blocks"]
        ]
        if row.get("wrapped") and not media:  # an attachment that can't be read is still one
            media = [{"href": None, "thumbnail": None, "kind": "UNKNOWN", "title": None, "absence": None}]
        usable = number is not None and number > 0
        reply = row.get("reply", (None, None))
        out.append(
            {
                "place": place,
                "row_kind": "SERVICE" if service else "MESSAGE" if usable else "UNPARSED",
                "dom_id": row["dom_id"],
                "message_id": number if usable else None,
                "is_joined": "joined" in row["classes"],
                "sender": text.get("from_name"),
                "sent_raw": row.get("sent_raw"),
                "text": text.get("body") if service else text.get("text"),
                "reply_to": reply[0],
                "reply_file": reply[1],
                "forwarded_from": text.get("forwarded_from"),
                "forwarded_raw": row.get("forwarded_raw"),
                "media": media,
                "contacts": row["contacts"],
            }
        )
    return out


def scan(pages: DataFrame) -> DataFrame:
    """The rows of pages(page_id, html). A page without any message element gives none."""
    importable(pages.sparkSession)
    text, flag, number = pa.string(), pa.bool_(), pa.int64()
    media = pa.list_(pa.struct([(c, text) for c in ("href", "thumbnail", "kind", "title", "absence")]))
    kinds = {"place": pa.int32(), "row_kind": text, "dom_id": text, "message_id": number, "is_joined": flag, "sender": text, "sent_raw": text, "text": text}
    kinds |= {"reply_to": number, "reply_file": text, "forwarded_from": text, "forwarded_raw": text, "media": media, "contacts": pa.list_(pa.struct([("kind", text), ("value", text)]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                rows = parse(html)
                columns = [pa.array([page_id] * len(rows), number), *(pa.array([r[c] for r in rows], k) for c, k in kinds.items())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", *kinds])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, SCHEMA)


def escaped(text: Column) -> Column:
    """Text as it stands in markup."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def exported(messages: DataFrame) -> DataFrame:
    """page_id, html: messages written as an exporter would, with every shape of row that the scan knows."""
    div = lambda kind, inner: F.concat(F.lit(f'<div class="{kind}">'), inner, F.lit("</div>\n"))
    number = F.col("message_id")
    dom = F.when(number % 13 == 7, F.lit("message")).when(F.col("is_service"), F.concat(F.lit("message-"), number.cast("string"))).otherwise(F.concat(F.lit("message"), number.cast("string")))
    sender = F.coalesce(div("from_name", escaped(F.col("sender"))), F.lit(""))
    date = F.concat(F.lit('<div class="pull_right date details" title="'), F.date_format(F.timestamp_seconds("sent_at"), "dd.MM.yyyy HH:mm:ss"), F.lit('">x</div>\n'))
    anchor = F.concat(F.when(number % 2 == 0, "messages2.html").otherwise(""), F.lit("#go_to_message"), F.col("reply_to").cast("string"))
    reply = F.coalesce(div("reply_to details", F.concat(F.lit('In reply to <a href="'), anchor, F.lit('">this message</a>'))), F.lit(""))
    photo = F.concat(F.lit('<a class="photo_wrap" href="photos/p'), number.cast("string"), F.lit('.jpg"><img src="photos/t'), number.cast("string"), F.lit('.jpg"></a>'))
    absent = div("media clearfix pull_left media_video", F.concat(div("title bold", F.lit("Video file")), div("description", F.lit(ABSENT[0]))))
    media = F.when(number % 4 == 1, div("media_wrap clearfix", photo)).when(number % 4 == 3, div("media_wrap clearfix", absent)).otherwise("")
    link = F.when(number % 6 == 0, F.lit('<a href="https://t.me/someone">@someone</a><a href="tel:+98 912">call</a>')).otherwise("")
    text = div("text", F.concat(escaped(F.coalesce("body", F.lit(""))), link))
    forwarded = F.when(number % 7 == 2, div("forwarded body", div("from_name", F.concat(F.lit("Origin "), (number % 5).cast("string"), F.lit('<span class="date details" title="01.02.2020 03:04:05"> then</span>'))))).otherwise("")
    inner = F.when(F.col("is_service"), div("body details", escaped(F.coalesce("body", F.lit(""))))).otherwise(div("body", F.concat(date, sender, reply, forwarded, media, text)))
    kind = F.when(F.col("is_service"), "message service").when(F.col("is_joined"), "message default clearfix joined").otherwise("message default clearfix")
    block = F.concat(F.lit('<div class="'), kind, F.lit('" id="'), dom, F.lit('">\n'), inner, F.lit("</div>\n"))
    rows = messages.select("page", F.struct(number.alias("message_id"), block.alias("block")).alias("m")).groupBy("page").agg(F.array_sort(F.collect_list("m")).alias("rows"))
    html = F.concat(F.lit('<html><body><div class="history">\n'), F.array_join(F.transform("rows", lambda r: r["block"]), ""), F.lit("</div></body></html>"))
    return rows.select(F.col("page").alias("page_id"), html.alias("html"))
