"""Readers and writers: Markdown vaults, conversation exports, mail, calendars, chats, transcripts, issues, HTML; sinks.

Each reader gives a DataFrame with an explicit schema; nested JSON is read with `from_json` or `spark.read.schema(...)`, never
by inference, so a job's plan doesn't depend on its data.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "path string, modificationTime timestamp, length long, content binary"


def markdown_files(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """path, modified, body: one row a file, found recursively."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("body"))


def frontmatter(body: Column) -> Column:
    """The key: value lines between the first two --- lines as a map of strings."""
    head = F.regexp_extract(body, r"(?s)\A---\n(.*?)\n---\n", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*:"))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), "^([\"'])(.*)\\1$", "$2")
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "^([^:]+):", 1).alias("key"), value(x).alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))


def without_frontmatter(body: Column) -> Column:
    return F.regexp_replace(body, r"(?s)\A---\n.*?\n---\n", "")


def sections(body: Column) -> Column:
    """A body cut before each # or ## heading; empty parts left out."""
    return F.filter(F.split(body, r"(?m)(?=^#{1,2} )"), lambda s: F.trim(s) != "")


def chunk(body: Column, most: int = 4000, overlap: int = 300) -> Column:
    """Sections, longer ones in windows of `most` characters that overlap: array of (index, content)."""
    step = most - overlap
    windows = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(s) - most) / step).cast("int"))), lambda i: F.substring(s, i * step + 1, F.lit(most)))
    return F.transform(F.flatten(F.transform(sections(body), windows)), lambda c, i: F.struct(i.alias("index"), c.alias("content")))


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good records, bad lines) of a JSON-lines source."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    parsed = rows.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").isNull().alias("bad"))
    return parsed.filter("not bad and r is not null").select("r.*"), parsed.filter("bad or r is null").select("value")


#: Line shapes of plain-text conversations (fixed values): name, pattern with (when, who, text).
LINE_SHAPES = (
    ("whatsapp", r"^\[?(\d{1,2}[/.]\d{1,2}[/.]\d{2,4},? \d{1,2}:\d{2}(?::\d{2})?)\]?(?: -)? ([^:]{1,60}): (.*)$"),
    ("telegram", r"^([^,\[\]:]{1,60}), \[(\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{2})\]:? ?(.*)$"),
    ("irc", r"^\[?(\d{1,2}:\d{2}(?::\d{2})?)\]? <([^>]{1,60})> (.*)$"),
    ("dated", r"^(\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?) ([^:]{1,60}): (.*)$"),
    ("plain", r"^()([A-Z][^:]{0,40}): (.*)$"),
)


def conversation_lines(text: Column) -> Column:
    """Array of (shape, when, who, text, index) for the lines that a shape fits."""

    def one(line: Column, i: Column) -> Column:
        out = F.lit(None).cast("struct<shape:string,moment:string,who:string,text:string,index:int>")
        for name, p in reversed(LINE_SHAPES):
            when, who = (2, 1) if name == "telegram" else (1, 2)
            got = F.struct(F.lit(name).alias("shape"), F.regexp_extract(line, p, when).alias("moment"), F.regexp_extract(line, p, who).alias("who"), F.regexp_extract(line, p, 3).alias("text"), i.alias("index"))
            out = F.when(line.rlike(p), got).otherwise(out)
        return out

    return F.array_compact(F.transform(F.split(text, "\n"), one))


CHAT_EXPORT = "title string, create_time double, mapping map<string, struct<id:string, parent:string, message:struct<author:struct<role:string>, create_time:double, content:struct<parts:array<string>>>>>"


def chat_tree_turns(conversations: DataFrame) -> DataFrame:
    """Turns of exported chats kept as trees of messages: title, id, parent, role, at, text; in order of time."""
    nodes = conversations.select("title", F.explode("mapping").alias("id", "n"))
    text = F.array_join(F.filter("n.message.content.parts", lambda p: p.isNotNull()), "\n")
    return nodes.filter("n.message is not null").select("title", "id", F.col("n.parent").alias("parent"), F.col("n.message.author.role").alias("role"), F.col("n.message.create_time").alias("at"), text.alias("text")).filter("text <> ''")


ROLLOUT = "timestamp timestamp, type string, payload struct<type:string, role:string, content:array<struct<type:string, text:string>>>"


def rollout_turns(records: DataFrame) -> DataFrame:
    """Messages of an agent rollout: at, role, text."""
    text = F.array_join(F.transform("payload.content", lambda c: c["text"]), "\n")
    return records.filter("payload.type = 'message' and payload.role in ('user', 'assistant')").select(F.col("timestamp").alias("at"), "payload.role", text.alias("text")).filter("text <> ''")


MAIL = "id string, threadId string, internalDate string, payload struct<headers:array<struct<name:string, value:string>>, body:struct<data:string>>, labelIds array<string>"


def mail_messages(raw: DataFrame) -> DataFrame:
    """Provider messages as rows: thread, id, at, sender, subject, body (base64url decoded)."""
    header = lambda name: F.element_at(F.transform(F.filter("payload.headers", lambda h: F.lower(h["name"]) == name), lambda h: h["value"]), 1)
    coded = F.translate("payload.body.data", "-_", "+/")
    pad = F.rpad(coded, (F.ceil(F.length(coded) / 4) * 4).cast("int"), F.lit("="))
    return raw.select(F.col("threadId").alias("thread"), "id", F.timestamp_millis(F.col("internalDate").cast("long")).alias("at"), header("from").alias("sender"), header("subject").alias("subject"), F.decode(F.unbase64(pad), "UTF-8").alias("body"))


EVENT = "id string, status string, summary string, start struct<dateTime:string, date:string>, `end` struct<dateTime:string, date:string>, attendees array<struct<email:string, responseStatus:string, self:boolean>>"


def calendar_events(raw: DataFrame) -> DataFrame:
    """id, title, from, to, all_day, attendees, owes_reply; cancelled events left out."""
    at = lambda c: F.coalesce(F.try_to_timestamp(f"{c}.dateTime"), F.try_to_timestamp(f"{c}.date"))
    owes = F.exists("attendees", lambda a: F.coalesce(a["self"], F.lit(False)) & (a["responseStatus"] == "needsAction"))
    return raw.filter("status <> 'cancelled'").select("id", F.col("summary").alias("title"), at("start").alias("from"), at("end").alias("to"), F.col("start.date").isNotNull().alias("all_day"), F.transform("attendees", lambda a: F.lower(a["email"])).alias("attendees"), F.coalesce(owes, F.lit(False)).alias("owes_reply"))


def chat_days(messages: DataFrame) -> DataFrame:
    """Messages (channel, at, who, text) as one document per channel and UTC day."""
    line = F.concat(F.date_format("at", "HH:mm"), F.lit(" "), F.col("who"), F.lit(": "), F.col("text"))
    day = messages.groupBy("channel", F.col("at").cast("date").alias("day")).agg(F.sort_array(F.collect_list(F.struct("at", line.alias("line")))).alias("l"), F.count("*").alias("n"))
    return day.select("channel", "day", "n", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


def vtt_cues(text: Column) -> Column:
    """Cues of a WebVTT transcript: array of (start, end, who, text)."""
    cue = r"(?m)^(\d{2}:\d{2}(?::\d{2})?\.\d{3}) --> (\d{2}:\d{2}(?::\d{2})?\.\d{3})[^\n]*\n((?:[^\n]+\n?)+)"
    part = lambda i: F.regexp_extract_all(text, F.lit(cue), F.lit(i))
    rows = F.arrays_zip(part(1).alias("start"), part(2).alias("end"), part(3).alias("body"))
    voice = r"(?s)<v ([^>]+)>"
    return F.transform(rows, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.regexp_extract(r["body"], voice, 1).alias("who"), F.trim(F.regexp_replace(F.regexp_replace(r["body"], "<[^>]*>", ""), r"\s+", " ")).alias("text")))


ISSUE = "number long, title string, state string, body string, updated_at timestamp, pull_request struct<url:string>, labels array<struct<name:string>>"


def issues(pages: DataFrame) -> DataFrame:
    """Issues and pull requests of fetched pages, the newest of each number."""
    one = pages.groupBy("number").agg(F.max(F.struct("updated_at", "title", "state", "body", F.col("pull_request").isNotNull().alias("is_pull"), F.transform("labels", lambda x: x["name"]).alias("labels"))).alias("i"))
    return one.select("number", "i.*")


#: Character sets of encoded words that Spark decodes, by the names that headers use (fixed values).
CHARSETS = {"utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "UTF-8", "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1", "windows-1252": "windows-1252", "utf-16": "UTF-16"}


def decoded_words(text: Column) -> Column:
    """=?charset?B?...?= and =?charset?Q?...?= words of a header decoded, each by its own character set; white space between two of
    them goes. Words of one character set that follow each other are decoded together, since a character may be cut between them."""
    word = r"=\?([^?\s*]{1,64})(?:\*[^?\s]{0,32})?\?([BbQq])\?([^?\s]*)\?="
    joined = F.regexp_replace(text, rf"({word})\s+(?={word})", "$1")
    found = F.regexp_extract_all(joined, F.lit(word), F.lit(0))

    def octets(w: Column) -> Column:
        body = F.regexp_extract(w, word, 3)
        # Q: "_" is a space and "=XX" a byte; other characters are their own byte.
        quoted = F.regexp_replace(F.regexp_replace(F.hex(F.replace(body, F.lit("_"), F.lit(" "))), "(..)", "$1,"), r"3D,3([0-9]),3([0-9]),", "$1$2,")
        quoted = F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r"3D,3([0-9]),4([1-6]),", "$1<$2,"), r"3D,4([1-6]),3([0-9]),", "<$1$2,"), r"3D,4([1-6]),4([1-6]),", "<$1<$2,")
        for i, c in enumerate("ABCDEF"):
            quoted = F.replace(quoted, F.lit(f"<{i + 1}"), F.lit(c))
        return F.when(F.lower(F.regexp_extract(w, word, 2)) == "q", F.unhex(F.replace(quoted, F.lit(","), F.lit("")))).otherwise(F.unbase64(body))

    def plain(charset: Column, data: Column) -> Column:
        out = F.decode(data, "UTF-8")
        for name, spark in CHARSETS.items():
            out = F.when(charset == name, F.decode(data, spark)).otherwise(out)
        return out

    # Runs of neighbouring words of one character set: (set, hex so far, text so far).
    runs = F.regexp_extract_all(joined, F.lit(rf"(?:{word})+"), F.lit(0))

    def run_text(r: Column) -> Column:
        words = F.regexp_extract_all(r, F.lit(word), F.lit(0))
        charset = lambda w: F.lower(F.regexp_extract(w, word, 1))
        zero = F.struct(F.lit("").alias("set"), F.lit("").alias("hex"), F.lit("").alias("out"))
        done = lambda s: F.concat(s["out"], plain(s["set"], F.unhex(s["hex"])))
        step = lambda s, w: F.when(s["set"] == charset(w), F.struct(s["set"].alias("set"), F.concat(s["hex"], F.hex(octets(w))).alias("hex"), s["out"].alias("out"))).otherwise(F.struct(charset(w).alias("set"), F.hex(octets(w)).alias("hex"), done(s).alias("out")))
        return F.aggregate(words, zero, step, done)

    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(runs, joined, lambda s, r: F.replace(s, r, run_text(r))))


def write_markdown(docs: DataFrame, path: str, name: str, body: str = "body") -> int:
    """One Markdown file for each document under `path`, a folder that all executors share, named by a column (`a/b` is b.md in a);
    how many were written. markdown_files reads them back."""
    from collections.abc import Iterator
    from pathlib import Path

    root = path.removeprefix("file://")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = [p for p in (n or "").split("/") if p not in ("", ".", "..")] or ["untitled"]
                file = Path(root, *parts[:-1], f"{parts[-1]}.md")
                file.parent.mkdir(parents=True, exist_ok=True)
                # A task that runs twice writes the same file: first aside, then in its place.
                aside = file.with_name(f".{file.name}.{uuid.uuid4().hex}")
                aside.write_text(t or "", encoding="utf-8")
                aside.replace(file)
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    return docs.select(F.col(name).cast("string"), F.col(body).cast("string")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def replace_by_key(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """A table with a batch's rows in place of those with their keys."""
    return table.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch)


def append_versions(versions: DataFrame, pages: DataFrame, body: str = "body") -> DataFrame:
    """New page versions: those whose content differs from the newest one; slug, version, digest, previous (a hash chain), body."""
    last = versions.groupBy("slug").agg(F.max(F.struct("version", "digest")).alias("l"))
    new = pages.select("slug", F.sha2(body, 256).alias("digest"), F.col(body).alias("body")).join(last, "slug", "left")
    changed = new.filter(~F.col("digest").eqNullSafe(F.col("l.digest")))
    return changed.select("slug", (F.coalesce("l.version", F.lit(0)) + 1).alias("version"), "digest", F.col("l.digest").alias("previous"), "body")


def table_digest(df: DataFrame) -> DataFrame:
    """One row that two tables share exactly if they hold the same rows, in any order: n, and two sums of row hashes."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    h = F.sha2(row, 256)
    part = lambda a: F.conv(F.substring(h, a, 12), 16, 10).cast("decimal(20,0)")
    return df.select(part(1).alias("a"), part(13).alias("b")).agg(F.count("*").alias("n"), F.sum("a").alias("digest_a"), F.sum("b").alias("digest_b"))


MESSAGES = "uuid string, name string, created_at string, chat_messages array<struct<uuid:string, sender:string, text:string, created_at:string, content:array<struct<type:string, text:string>>>>"


def chat_list_turns(raw: DataFrame) -> DataFrame:
    """Chat exports that list their messages (schema MESSAGES): conversation, title, turn, id, role, at, text; other senders and messages
    without text are left out, and so are conversations without an id."""
    rows = raw.filter(F.trim("uuid") != "").select(F.trim("uuid").alias("conversation"), F.nullif(F.trim("name"), F.lit("")).alias("title"), F.posexplode("chat_messages").alias("turn", "m"))
    blocks = F.trim(F.array_join(F.transform(F.filter("m.content", lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n\n"))
    text = F.coalesce(F.nullif(blocks, F.lit("")), F.nullif(F.trim("m.text"), F.lit("")))
    role = F.when(F.col("m.sender") == "human", "user").when(F.col("m.sender") == "assistant", "assistant")
    out = rows.select("conversation", "title", "turn", F.col("m.uuid").alias("id"), role.alias("role"), F.try_to_timestamp("m.created_at").alias("at"), text.alias("text"))
    return out.filter("role is not null and text is not null")


def export_format(record: Column) -> Column:
    """Which kind of chat export a JSON record is of: tree, list, rollout, session, or null."""
    has = lambda path: F.get_json_object(record, path).isNotNull()
    return F.when(has("$.mapping"), "tree").when(has("$.chat_messages") & has("$.uuid"), "list").when(has("$.payload") & has("$.timestamp"), "rollout").when(has("$.sessionId") & has("$.message"), "session")


def detected_format(records: DataFrame, column: str = "value", probe: int = 20) -> DataFrame:
    """One row: the format of the first records that have one (by order of tree, list, rollout, session); null if none has."""
    order = F.array_position(F.lit(["tree", "list", "rollout", "session"]), F.col("format"))
    found = records.limit(probe).select(export_format(F.col(column)).alias("format")).filter("format is not null")
    return found.agg(F.min(F.struct(order.alias("n"), "format"))["format"].alias("format"))


OFFICE_MAIL = "id string, conversationId string, receivedDateTime string, subject string, `from` struct<emailAddress:struct<name:string, address:string>>, body struct<contentType:string, content:string>, isDraft boolean"


def office_messages(raw: DataFrame) -> DataFrame:
    """Mail of an office suite's JSON: thread, id, at, sender, subject, body (HTML as text); drafts are left out."""
    from millrace.functions.text import html_text

    body = F.when(F.lower("body.contentType") == "html", F.regexp_replace(html_text(F.col("body.content")), r"^\s+|\s+$", "")).otherwise(F.col("body.content"))
    kept = raw.filter(~F.coalesce("isDraft", F.lit(False)))
    return kept.select(F.col("conversationId").alias("thread"), "id", F.try_to_timestamp("receivedDateTime").alias("at"), F.lower("from.emailAddress.address").alias("sender"), "subject", body.alias("body"))


OFFICE_EVENT = "id string, subject string, isCancelled boolean, isAllDay boolean, start struct<dateTime:string, timeZone:string>, `end` struct<dateTime:string, timeZone:string>, responseStatus struct<response:string>, attendees array<struct<emailAddress:struct<address:string>, status:struct<response:string>>>"


def office_events(raw: DataFrame) -> DataFrame:
    """Events of an office suite's JSON, as calendar_events gives them; times in the zone that they name, as UTC."""
    at = lambda c: F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(f"{c}.dateTime", r"\.\d+$", "")), F.coalesce(f"{c}.timeZone", F.lit("UTC")))
    owes = F.coalesce(F.lower("responseStatus.response").isin("notresponded", "none"), F.lit(False))
    kept = raw.filter(~F.coalesce("isCancelled", F.lit(False)))
    return kept.select("id", F.col("subject").alias("title"), at("start").alias("from"), at("end").alias("to"), F.coalesce("isAllDay", F.lit(False)).alias("all_day"), F.transform("attendees", lambda a: F.lower(a["emailAddress"]["address"])).alias("attendees"), owes.alias("owes_reply"))


TRANSCRIPT = "id string, title string, date long, sentences array<struct<speaker_name:string, text:string, start_time:double, end_time:double>>"


def meeting_turns(raw: DataFrame) -> DataFrame:
    """Recorded meetings (schema TRANSCRIPT): meeting, title, held, turn, who, starts, text; a speaker's sentences that follow each
    other are one turn. A meeting is one row, and so one task's work."""
    rows = raw.select(F.col("id").alias("meeting"), "title", F.timestamp_millis("date").alias("held"), F.filter("sentences", lambda s: F.coalesce(F.trim(s["text"]) != "", F.lit(False))).alias("s"))
    opens = F.filter(F.sequence(F.lit(0), F.size("s")), lambda i: (i < F.size("s")) & ((i == 0) | ~F.get("s", i)["speaker_name"].eqNullSafe(F.get("s", i - 1)["speaker_name"])))
    turns = rows.withColumn("opens", opens).select("meeting", "title", "held", "s", "opens", F.posexplode("opens").alias("turn", "a"))
    end = F.coalesce(F.get("opens", F.col("turn") + 1), F.size("s"))
    said = F.array_join(F.transform(F.slice("s", F.col("a") + 1, end - F.col("a")), lambda x: F.trim(x["text"])), " ")
    return turns.select("meeting", "title", "held", "turn", F.get("s", F.col("a"))["speaker_name"].alias("who"), F.get("s", F.col("a"))["start_time"].alias("starts"), said.alias("text"))
