"""Code as data: symbols and chunks of source files, calls resolved by scope, walks over them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import lexer
from millrace.sources.shared import settled


def language(path: Column) -> Column:
    """By the extension of a path; null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in lexer.LANGUAGES.items() for x in kv]), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def _lexed(files: DataFrame, made, schema: str, path: str, text: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            rows = (row for p, lang, source in zip(b["path"], b["language"], b["source"], strict=True) for row in made(p, lang, source))
            while some := list(islice(rows, 10_000)):
                yield pd.DataFrame(some, columns=names)

    src = files.select(F.col(path).alias("path"), language(F.col(path)).alias("language"), F.coalesce(F.col(text), F.lit("")).alias("source")).filter("language is not null")
    return src.mapInPandas(run, schema)


def _qualified(s: lexer.Symbol) -> str:
    return ".".join((*s.path, s.name))


def symbols(files: DataFrame, path: str = "path", text: str = "source") -> DataFrame:
    """(path, language, symbol, qualified, kind, start_line, end_line) of Python, TypeScript and Go files; other files have none."""

    def made(p, lang, source):
        line = lexer.line_numbers(source)
        for s in lexer.symbols(source, lang):
            yield p, lang, s.name, _qualified(s), s.kind, line(s.start), line(max(s.start, s.end - 1))

    return _lexed(files, made, "path string, language string, symbol string, qualified string, kind string, start_line int, end_line int", path, text)


def chunks(files: DataFrame, most: int = 4000, path: str = "path", text: str = "source") -> DataFrame:
    """(path, index, symbol, kind, start_line, content): pieces of at most `most` characters that make up each file, cut at symbols of the top."""

    def made(p, lang, source):
        found, line = lexer.symbols(source, lang), lexer.line_numbers(source)
        for n, (a, b, i) in enumerate(lexer.chunks(source, found, most)):
            yield p, n, found[i].name if i >= 0 else None, found[i].kind if i >= 0 else None, line(a), source[a:b]

    return _lexed(files, made, "path string, index int, symbol string, kind string, start_line int, content string", path, text)


def imports(files: DataFrame, path: str = "path", text: str = "source") -> DataFrame:
    """(path, name, original, module)."""
    return _lexed(files, lambda p, lang, source: ((p, *x) for x in lexer.imports(source, lang)), "path string, name string, original string, module string", path, text)


def calls(files: DataFrame, path: str = "path", text: str = "source") -> DataFrame:
    """(path, language, caller, callee): each call once per caller; the caller is the qualified symbol around it, null at the top of a file."""

    def made(p, lang, source):
        found = lexer.symbols(source, lang)
        for i, callee in lexer.calls(source, lang, found):
            yield p, lang, _qualified(found[i]) if i >= 0 else None, callee

    return _lexed(files, made, "path string, language string, caller string, callee string", path, text)


def lexed(files: DataFrame, path: str = "path", text: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """calls, symbols and imports, of one pass over the files whose result is written."""

    def made(p, lang, source):
        found = lexer.symbols(source, lang)
        for s in found:
            yield "symbol", p, lang, s.name, _qualified(s), None
        for i, callee in lexer.calls(source, lang, found):
            yield "call", p, lang, callee, _qualified(found[i]) if i >= 0 else None, None
        for name, original, module in lexer.imports(source, lang):
            yield "import", p, lang, name, original, module

    one = settled(_lexed(files, made, "part string, path string, language string, a string, b string, c string", path, text))
    of = lambda part, *names: one.filter(F.col("part") == part).select("path", *names)
    a, b, c = map(F.col, "abc")
    return of("call", "language", b.alias("caller"), a.alias("callee")), of("symbol", "language", a.alias("symbol"), b.alias("qualified")), of("import", a.alias("name"), b.alias("original"), c.alias("module"))


def symbol_id(path: Column, qualified: Column) -> Column:
    return F.concat_ws("::", path, qualified)


def resolved(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """calls with state (resolved, ambiguous or unresolved), scope (file, import or global), target (a symbol's id) and candidates.

    A callee is looked for in its own file, by its qualified or its bare name and never the caller itself; then, if the file imports its first name,
    in files whose name is the module's last part; then among all files of its language. The first scope that has candidates decides: one
    is the target, several are ambiguous. Every scope is an equi-join on counted names, so a name that very many files define is one row.
    """
    named = symbols.select("path", "language", "symbol", "qualified", symbol_id(F.col("path"), F.col("qualified")).alias("id"))
    # Written, as every scope counts them and they are lexed.
    every = settled(named.select("path", "language", "id", F.explode(F.array_distinct(F.array("symbol", "qualified"))).alias("name")))
    counted = lambda df, keys: df.groupBy(*keys).agg(F.count_distinct("id").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    as_one = lambda df, keys, x: df.select(*keys, F.struct("n", "low", "high").alias(x))
    c = calls.withColumn("bare", F.element_at(F.split("callee", r"\."), -1)).withColumn("head", F.element_at(F.split("callee", r"\."), 1))
    c = c.withColumn("own", F.when(F.col("caller").isNotNull(), symbol_id(F.col("path"), F.col("caller"))))
    # self.f() and this.f() mean a symbol of the file.
    c = c.withColumn("name", F.when(F.col("head").isin("self", "this", "cls"), F.col("bare")).otherwise(F.col("callee")))
    c = c.join(as_one(counted(every, ["path", "name"]), ["path", "name"], "file"), ["path", "name"], "left")
    brought = imports.select("path", F.col("name").alias("head"), "original", F.element_at(F.split(F.regexp_replace("module", r"\.\w{1,3}$", ""), r"[/.]"), -1).alias("stem")).dropDuplicates(["path", "head"])
    c = settled(c.join(brought, ["path", "head"], "left"))
    c, rest = c.filter("stem is not null"), c.filter("stem is null")
    c = c.withColumn("wanted", F.when(F.col("stem").isNotNull(), F.when(F.col("head") == F.col("callee"), F.col("original")).otherwise(F.col("bare"))))
    # from a import b; b.f(): b may be the module itself.
    stems = F.regexp_extract("path", r"([^/]*?)\.[^./]+$", 1)
    by_stem = as_one(counted(every.withColumn("stem", stems), ["stem", "language", "name"]), ["stem", "language", "name"], "import")
    module = F.when((F.col("head") != F.col("callee")) & F.col("stem").isNotNull() & (F.col("original") != "default"), F.col("original")).otherwise(F.col("stem"))
    c = c.withColumn("stem2", module)
    first = by_stem.withColumnsRenamed({"stem": "stem2", "name": "wanted"})
    c = c.join(first, ["stem2", "language", "wanted"], "left")
    c = c.join(by_stem.withColumnsRenamed({"name": "wanted", "import": "import2"}), ["stem", "language", "wanted"], "left")
    # What no import brings in isn't looked for there.
    c = c.unionByName(rest, allowMissingColumns=True)
    c = c.join(as_one(counted(every.withColumnRenamed("name", "bare"), ["language", "bare"]), ["language", "bare"], "global"), ["language", "bare"], "left")
    # Without the caller itself.
    less = lambda x: F.col(f"{x}.n") - F.coalesce((F.col("own") == F.col(f"{x}.low")) | (F.col("own") == F.col(f"{x}.high")), F.lit(False)).cast("int")
    one = lambda x: F.when(F.col("own") == F.col(f"{x}.low"), F.col(f"{x}.high")).otherwise(F.col(f"{x}.low"))
    picked = F.coalesce(*[F.when(less(x) > 0, F.struct(F.lit(scope).alias("scope"), less(x).alias("n"), one(x).alias("target"))) for x, scope in (("file", "file"), ("import", "import"), ("import2", "import"), ("global", "global"))])
    c = c.withColumn("to", picked)
    state = F.when(F.col("to").isNull(), "unresolved").when(F.col("to.n") == 1, "resolved").otherwise("ambiguous")
    return c.select("path", "language", "caller", "callee", state.alias("state"), "to.scope", F.when(F.col("to.n") == 1, F.col("to.target")).alias("target"), F.coalesce("to.n", F.lit(0)).cast("int").alias("candidates"))


def edges(resolved: DataFrame) -> DataFrame:
    """(source_slug, target_slug, type) of resolved calls, for walks over graphs."""
    source = F.coalesce(symbol_id(F.col("path"), F.col("caller")), F.concat("path", F.lit("::__module__")))
    return resolved.filter("state = 'resolved'").select(source.alias("source_slug"), F.col("target").alias("target_slug"), F.lit("calls").alias("type")).distinct()


def walk(edges: DataFrame, start: list[str], depth: int, direction: str) -> DataFrame:
    """(slug, depth, confidence): callers (direction `in`) or callees (`out`) of symbols, sure by how near they are."""
    from millrace.operators.graph import traverse

    found = traverse(edges, start, depth, direction)
    return found.withColumn("confidence", F.greatest(F.lit(0.05), F.least(F.lit(1.0), 1 / (1 + 0.3 * F.col("depth")))))
