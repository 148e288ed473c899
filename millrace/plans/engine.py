"""A database on a Spark session: statements of the dialect, tables with copy-on-write changes, saving and loading.

Queries are rewritten to one Spark statement and stay lazy. Tables are Parquet folders below the engine's own folder:
INSERT appends files; UPDATE, DELETE and ALTER write a new version and then switch to it, so a reader always sees a
whole version. The catalog (names, defaults, sequences) is kept on the driver, the data never is.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DayTimeIntervalType

from millrace.functions import udfs
from millrace.operators.joins import asof_join
from millrace.operators.recursion import fixpoint
from millrace.plans.dialect import CLAUSES, Group, Rewriter, Word, bare, calls, clauses, key, split, statements
from millrace.sources import files

NO_EFFECT = ("begin", "start", "commit", "rollback", "savepoint", "release", "pragma", "set", "reset", "analyze", "checkpoint", "vacuum")


@dataclass
class Table:
    path: str
    schema: str
    defaults: dict[str, str] = field(default_factory=dict)


@dataclass
class Sequence:
    start: int = 1
    step: int = 1
    low: int | None = None
    high: int | None = None
    cycle: bool = False
    last: int | None = None

    def next(self) -> int:
        value = self.start if self.last is None else self.last + self.step
        if self.high is not None and value > self.high or self.low is not None and value < self.low:
            if not self.cycle:
                raise ValueError("the sequence has reached its end")
            value = self.start
        self.last = value
        return value


#: Words that can follow a table without being its alias.
ENDS = frozenset("where group having window qualify order limit offset join left right full inner cross natural semi anti asof on using union intersect except set values select pivot unpivot lateral default".split())


def shared_folder(spark: SparkSession) -> str:
    """Where tables are kept: spark.checkpoint.dir, or a folder of this machine if it is the only one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="millrace-db-")


class Result:
    """What a statement returned, as a lazy DataFrame with the usual helpers."""

    def __init__(self, df: DataFrame):
        self.df = df

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.df.collect()]

    def row_count(self) -> int:
        return self.df.count()

    def column_count(self) -> int:
        return len(self.df.columns)

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def scalar(self):
        first = self.df.first()
        return None if first is None else first[0]

    def to_table_string(self, rows: int = 20) -> str:
        shown = [self.columns, *[["NULL" if v is None else str(v) for v in r] for r in self.df.limit(rows).collect()]]
        widths = [max(len(r[i]) for r in shown) for i in range(len(self.columns))]
        lines = [" | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)) for r in shown]
        return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:]])


class Engine:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.tables, self.sequences, self.indexes = spark, {}, {}, {}
        self.schemas, self.views = set(), set()
        self.folder = folder or shared_folder(spark)
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "1000")
        spark.conf.set("spark.sql.timeType.enabled", "true")
        spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")

    # tables that are there already

    def attach(self, folder: str, names: tuple[str, ...]) -> Engine:
        """Parquet tables of a folder, by name. Plain scans: filters and columns reach the files."""
        for name in names:
            self.spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
            self.views.add(name)
        return self

    # statements

    def sql(self, text: str) -> DataFrame:
        return self._run(statements(text)[0])

    def execute(self, text: str) -> Result:
        return Result(self.sql(text))

    def execute_batch(self, text: str) -> list[Result]:
        return [Result(self._run(s)) for s in statements(text)]

    def query_value(self, text: str):
        return self.execute(text).scalar()

    def query_column(self, text: str) -> list:
        return [r[0] for r in self.sql(text).collect()]

    def _plan(self, text: str) -> DataFrame:
        if "millrace_" in text:  # a function of our own
            udfs.register(self.spark)
        return self.spark.sql(text)

    def _message(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "result string")

    def _query(self, items: list) -> DataFrame:
        items = self._unqualified(items)
        if len(items) > 1 and key(items[1]) == "recursive" and (found := self._recursive(items)) is not None:
            return found
        items = self._sequenced(self._per_row(items))
        temporal: set[str] = set()
        while True:  # what is a date or a time is known to the planner only, which names one expression at a time
            try:
                df = self._plan(text := Rewriter(self._file, self._asof, frozenset(temporal)).query(items))
                break
            except AnalysisException as error:
                found = re.search(r'"avg\((.*?)\)" due to data type mismatch.*has the type "(?:DATE|TIMESTAMP|TIMESTAMP_NTZ)"', str(error), re.S)
                if not found or bare(found[1]) in temporal:
                    raise
                temporal.add(bare(found[1]))
        days = DayTimeIntervalType(DayTimeIntervalType.DAY, DayTimeIntervalType.DAY)
        if "interval" in text.lower() or all(f.dataType != days for f in df.schema):
            return df
        # Differences of dates are numbers.
        return df.select(*[F.expr(f"cast(extract(DAY FROM `{f.name}`) as bigint)").alias(f.name) if f.dataType == days else F.col(f"`{f.name}`") for f in df.schema])

    def _unqualified(self, items: list) -> list:
        """Tables of schemas by the names that they have as views, with their own names as aliases."""
        out, i = [], 0
        while i < len(items):
            x = items[i]
            if isinstance(x, Group):
                out.append(Group(x.open, self._unqualified(x.items)))
            elif i + 2 < len(items) and key(items[i + 1]) == "." and key(x) in (*self.schemas, "main") and isinstance(items[i + 2], Word):
                name, after = items[i + 2], items[i + 3] if i + 3 < len(items) else None
                if key(after) == "." or key(x) == "main":  # a column by its table, or a table of the plain schema
                    out.append(name)
                else:
                    out.append(Word(f"{key(x)}__{key(name)}", "w"))
                    if not (isinstance(after, Word) and (key(after) == "as" or after.kind == "w" and key(after) not in ENDS)):
                        out += [Word("AS", "w"), name]
                i += 2
            else:
                out.append(x)
            i += 1
        return out

    def _recursive(self, items: list) -> DataFrame | None:
        """WITH RECURSIVE r AS (a UNION b): rounds until no row is new. None if no part of the kind is there."""
        stop = next(i for i, x in enumerate(items) if key(x) in ("select", "values", "from"))
        parts = split(items[2:stop], ",")
        for part in parts:
            name, body = key(part[0]), part[-1].items
            at = next((i for i, x in enumerate(body) if key(x) == "union" and key(body[i + 1]) != "all"), None)
            if at is None or not _refers(body[at:], name):
                continue
            rest = [p for p in parts if p is not part]
            before = [Word("WITH", "w"), *[x for n, p in enumerate(rest) for x in ([Word(",", "o")] if n else []) + p]] if rest else []
            base = self._query([*before, *body[:at]])
            if isinstance(part[1], Group):
                base = base.toDF(*[x.text for x in part[1].items if key(x) != ","])
            fields, step_items = base.schema.fields, body[at + (2 if key(body[at + 1]) == "distinct" else 1) :]

            def step(new: DataFrame, before=before, fields=fields, step_items=step_items, name=name) -> DataFrame:
                found = self._query([*before, *_renamed(step_items, name, self._view(new))])
                return found.toDF(*[f.name for f in fields]).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in fields])

            done = self._view(fixpoint(base, step))
            return self._query([*before, *_renamed(items[stop:], name, done)])
        return None

    def _view(self, df: DataFrame) -> str:
        view = f"rows_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        return view

    def _per_row(self, items: list) -> list:
        """nextval over the rows of a table: its rows are numbered, and the sequence goes on after the last one."""
        if not items or key(items[0]) != "select":
            return items
        c = clauses(items)
        wanted = calls(c["select"], ("nextval",))
        if not wanted or "from" not in c:
            return items
        source = c["from"]
        if isinstance(source[0], Group) or any(not isinstance(x, Word) for x in source[1:]) or len(source) > 3:
            raise ValueError("nextval goes over the rows of one table; put a join into a view")
        where = [Word("WHERE", "w"), *c["where"]] if "where" in c else []
        rows = self._query([Word("SELECT", "w"), Word("*", "o"), Word("FROM", "w"), *source, *where])
        path = f"{self.folder}/numbered-{uuid.uuid4().hex}"
        rows.withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
        kept = self.spark.read.parquet(path)
        part = F.shiftright("__id", 33)
        before, places = 0, []
        for p, n in sorted(kept.groupBy(part).agg(F.count(F.lit(1))).collect()):  # a row for each task
            places.append((p, before))
            before += n
        offsets = self.spark.createDataFrame(places, "__p long, __b long")
        numbered = kept.join(F.broadcast(offsets), part == F.col("__p")).withColumn("__row", F.col("__b") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__p", "__b")
        first = {}
        for name in {g.items[0].text.strip("'").lower() for g in wanted} if before else ():
            s = self.sequences[name]
            first[name] = s.next()
            s.last += s.step * (before - 1)
            if s.high is not None and s.last > s.high or s.low is not None and s.last < s.low:
                raise ValueError("the sequence has reached its end")

        def valued(items: list) -> list:
            out: list = []
            for i, x in enumerate(items):
                if isinstance(x, Group) and i and key(items[i - 1]) == "nextval":
                    name = x.items[0].text.strip("'").lower()
                    out[-1] = Word(f"({first.get(name, 0)} + {self.sequences[name].step} * __row)", "n")
                else:
                    out.append(Group(x.open, valued(x.items)) if isinstance(x, Group) else x)
            return out

        chosen = valued(c["select"])
        if key(chosen[0]) == "*":
            chosen[1:1] = [Word("EXCLUDE", "w"), Group("(", [Word("__row", "w")])]
        c = c | {"select": chosen, "from": [Word(self._view(numbered), "w"), Word("AS", "w"), source[-1]]}
        return [y for k, v in c.items() if k != "where" for y in [*[Word(w, "w") for w in k.split()], *v]]

    def _run(self, items: list) -> DataFrame:
        first, second = key(items[0]), key(items[1]) if len(items) > 1 else ""
        if first in ("select", "with", "values", "from") or isinstance(items[0], Group):
            return self._query(items)
        if first == "explain":
            plan = self._query(items[1:])
            return self._message(plan._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        if first in NO_EFFECT:
            return self._message(first.upper())
        if first == "create":
            return self._create(items[1:])
        if first == "drop":
            return self._drop(items[1:])
        if first == "insert":
            return self._insert(items[2:])
        if first == "update":
            return self._update(items)
        if first == "delete":
            return self._delete(items)
        if first == "alter":
            return self._alter(items[2:])
        if first == "copy":
            return self._copy(items[1:])
        raise ValueError(f"unknown statement: {first} {second}")

    # what queries refer to

    def _sequenced(self, items: list) -> list:
        """nextval and currval become numbers; as in a VALUES row or a SELECT without FROM, each call is one value."""
        out = []
        for i, x in enumerate(items):
            if isinstance(x, Group):
                name = key(items[i - 1]) if i else ""
                if name in ("nextval", "currval"):
                    s = self.sequences[x.items[0].text.strip("'").lower()]
                    out[-1] = Word(str(s.next() if name == "nextval" else s.last), "n")
                    continue
                x = Group(x.open, self._sequenced(x.items))
            out.append(x)
        return out

    def _file(self, kind: str, args: list) -> str:
        plain = [args] if args and isinstance(args[0], Word) else args
        path = plain[0][0].text[1:-1]
        options = {a[0].text.lower(): a[-1].text.strip("'") for a in plain[1:]}
        view = f"file_{uuid.uuid4().hex}"
        files.read(self.spark, path, files.READERS.get(kind), options).createOrReplaceTempView(view)
        return view

    def _asof(self, rewriter: Rewriter, items: list) -> str:
        """a ASOF [LEFT] JOIN b [MATCH_CONDITION (..)] ON/USING .. as a view with the columns of both sides."""
        at = next(i for i, x in enumerate(items) if key(x) == "asof")
        left, rest = items[:at], items[at + 1 :]
        how = "left" if key(rest[0]) in ("left", "match_condition") or any(key(x) == "match_condition" for x in rest) else "inner"
        rest = rest[next(i for i, x in enumerate(rest) if key(x) == "join") + 1 :]
        stop = next(i for i, x in enumerate(rest) if key(x) in ("on", "using", "match_condition"))
        right, rest = rest[:stop], rest[stop:]
        names = [side[-1].text for side in (left, right)]
        frames = [self._plan(f"SELECT * FROM {rewriter.source(side)}") for side in (left, right)]
        tests: list[tuple[str, str, str]] = []

        def column(part: list) -> str:
            return part[-1].text

        i = 0
        while i < len(rest):
            k = key(rest[i])
            if k == "using":
                shared = [x.text for x in rest[i + 1].items if isinstance(x, Word) and x.kind in "wq"]
                tests += [(c, "=" if n < len(shared) - 1 or any(t[1] != "=" for t in tests) else ">=", c) for n, c in enumerate(shared)]
                i += 2
                continue
            body = rest[i + 1].items if isinstance(rest[i + 1], Group) else rest[i + 1 :]
            for part in split(body, "and"):
                op = next(j for j, x in enumerate(part) if key(x) in ("=", ">=", ">", "<=", "<"))
                a, b, o = part[:op], part[op + 1 :], key(part[op])
                if a[0].text == names[1]:
                    a, b, o = b, a, {">=": "<=", "<=": ">=", ">": "<", "<": ">", "=": "="}[o]
                tests.append((column(a), o, column(b)))
            i += 2 if isinstance(rest[i + 1], Group) else len(rest)
        renamed = [f.select(*[F.col(c).alias(f"{n}__{c}") for c in f.columns]) for n, f in zip(names, frames, strict=True)]
        near = next(t for t in tests if t[1] != "=")
        keys = [(f"{names[0]}__{a}", f"{names[1]}__{b}") for a, o, b in tests if o == "="]
        joined = asof_join(renamed[0], renamed[1], keys, (f"{names[0]}__{near[0]}", f"{names[1]}__{near[2]}"), near[1], how)
        view = f"asof_{uuid.uuid4().hex}"
        # Structs by the sides' names, so that a.x and b.y mean what they say.
        joined.select(*[F.struct(*[F.col(f"{n}__{c}").alias(c) for c in f.columns]).alias(n) for n, f in zip(names, frames, strict=True)]).createOrReplaceTempView(view)
        return view

    # tables

    def _name(self, items: list) -> str:
        words = [x.text.strip('"').lower() for x in items if isinstance(x, Word) and x.kind in "wq"]
        if len(words) > 1 and any(key(x) == "." for x in items) and words[-2] not in ("main", "memory"):
            if words[-2] not in self.schemas:
                raise ValueError(f"schema {words[-2]} isn't there")
            return f"{words[-2]}__{words[-1]}"
        return words[-1]

    def _register(self, name: str, table: Table) -> None:
        self.tables[name] = table
        self.spark.read.schema(table.schema).parquet(table.path).createOrReplaceTempView(name)

    def _new(self, name: str, df: DataFrame, defaults: dict[str, str] | None = None) -> None:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._register(name, Table(path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), defaults or {}))

    def _frame(self, name: str) -> DataFrame:
        table = self.tables[name]
        return self.spark.read.schema(table.schema).parquet(table.path)

    def _create(self, items: list) -> DataFrame:
        words = [key(x) for x in items]
        replace = words[:2] == ["or", "replace"]
        items = [x for x in (items[2:] if replace else items) if key(x) not in ("temp", "temporary", "unique")]
        kind, items = key(items[0]), items[1:]
        exists = [key(x) for x in items[:3]] == ["if", "not", "exists"]
        items = items[3:] if exists else items
        stop = next((i for i, x in enumerate(items) if isinstance(x, Group) or key(x) in ("as", "on", "start", "increment", "minvalue", "maxvalue", "cycle", "no")), len(items))
        name, rest = self._name(items[:stop]), items[stop:]
        if kind == "schema":
            if name in self.schemas and not exists:
                raise ValueError(f"schema {name} exists")
            self.schemas.add(name)
        elif kind == "view":
            body = next(i for i, x in enumerate(rest) if key(x) == "as")
            df = self._query(rest[body + 1 :])
            if isinstance(rest[0], Group):
                df = df.toDF(*[x.text for x in rest[0].items if key(x) != ","])
            df.createOrReplaceTempView(name)
            self.views.add(name)
        elif kind == "sequence":
            s, text = Sequence(), " ".join(x.text.lower() for x in rest)
            for attribute, pattern in (("start", r"start(?: with)? (- )?(\d+)"), ("step", r"increment(?: by)? (- )?(\d+)"), ("low", r"(?<!no )minvalue (- )?(\d+)"), ("high", r"(?<!no )maxvalue (- )?(\d+)")):
                if m := re.search(pattern, text):
                    setattr(s, attribute, int(m[2]) * (-1 if m[1] else 1))
            s.cycle = "cycle" in text and "no cycle" not in text
            self.sequences[name] = s
        elif kind == "index":
            self.indexes[name] = [x.text for x in rest if isinstance(x, Word)]
        elif kind == "table":
            if name in self.tables and not replace:
                if exists:
                    return self._message("exists")
                raise ValueError(f"table {name} exists")
            if isinstance(rest[0], Word):
                self._new(name, self._query(rest[1:]))
            else:
                fields, defaults = [], {}
                for part in split(rest[0].items, ","):
                    if key(part[0]) in ("primary", "unique", "check", "foreign", "constraint"):
                        continue  # not enforced
                    end = next((i for i, x in enumerate(part) if key(x) in ("not", "null", "default", "primary", "unique", "check", "references")), len(part))
                    column = part[0].text.strip('"')
                    fields.append(f"`{column}` {Rewriter().type(part[1:end])}")
                    at = next((i for i, x in enumerate(part) if key(x) == "default"), None)
                    if at is not None:
                        last = next((i for i in range(at + 2, len(part)) if key(part[i]) in ("not", "primary", "unique", "check")), len(part))
                        defaults[column.lower()] = Rewriter().expr(part[at + 1 : last])
                self._new(name, self.spark.createDataFrame([], ", ".join(fields)), defaults)
        else:
            raise ValueError(f"can't create a {kind}")
        return self._message(f"created {name}")

    def _drop(self, items: list) -> DataFrame:
        kind, words = key(items[0]), [key(x) for x in items]
        rest = [x for x in items[1:] if key(x) not in ("cascade", "restrict", "if", "exists")]
        name = self._name(rest)
        there = {"table": self.tables, "view": self.views, "schema": self.schemas, "sequence": self.sequences, "index": self.indexes}[kind]
        if name not in there:
            if "exists" not in words:
                raise ValueError(f"{kind} {name} isn't there")
            return self._message(f"no {name}")
        if kind == "schema":
            inside = [t for t in self.tables if t.startswith(f"{name}__")]
            if inside and "cascade" not in words:
                raise ValueError(f"schema {name} has tables")
            for t in inside:
                self.tables.pop(t)
                self.spark.catalog.dropTempView(t)
        elif kind in ("table", "view"):
            self.spark.catalog.dropTempView(name)
        there.discard(name) if isinstance(there, set) else there.pop(name)
        return self._message(f"dropped {name}")

    def _count(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "count long")

    def _insert(self, items: list) -> DataFrame:
        stop = next(i for i, x in enumerate(items) if isinstance(x, Group) or key(x) in ("values", "select", "with", "from", "default"))
        name, rest = self._name(items[:stop]), items[stop:]
        table, fields = self.tables[name], self._frame(name).schema.fields
        columns = [f.name for f in fields]
        given = columns
        if isinstance(rest[0], Group) and key(rest[0].items[0]) not in ("select", "with", "values"):
            given, rest = [x.text.strip('"').lower() for x in rest[0].items if key(x) != ","], rest[1:]
            if unknown := set(given) - {c.lower() for c in columns}:
                raise ValueError(f"{name} has no column {sorted(unknown)[0]}")
        if key(rest[0]) == "values":  # DEFAULT stands for its column's

            def filled(x):
                if not isinstance(x, Group):
                    return x
                parts = [[Word(f"({table.defaults.get(given[n].lower(), 'null')})", "n")] if [key(y) for y in part] == ["default"] else part for n, part in enumerate(split(x.items, ","))]
                return Group(x.open, [y for n, part in enumerate(parts) for y in ([Word(",", "o")] if n else []) + part])

            rest = [filled(x) for x in rest]
        rows = self._query(rest)
        rows = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
        at = {c.lower(): f"c{i}" for i, c in enumerate(given)}
        out = rows.select(*[(F.col(at[f.name.lower()]) if f.name.lower() in at else F.expr(table.defaults.get(f.name.lower(), "null"))).cast(f.dataType).alias(f.name) for f in fields])
        part = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        out.write.parquet(part)  # once, so that what is counted is what is added
        new = self.spark.read.schema(table.schema).parquet(part)
        new.write.mode("append").parquet(table.path)
        self._register(name, table)
        return self._count(new.count())

    def _update(self, items: list) -> DataFrame:
        at, where = next(i for i, x in enumerate(items) if key(x) == "set"), next((i for i, x in enumerate(items) if key(x) == "where"), len(items))
        name = self._name(items[1:at])
        df, r = self._frame(name), Rewriter(self._file, self._asof)
        test = f"coalesce({r.expr(items[where + 1 :])}, false)" if where < len(items) else "true"
        new = {p[0].text.strip('"').lower(): r.expr(p[2:]) for p in split(items[at + 1 : where], ",")}
        n = self._plan(f"SELECT count_if({test}) FROM {name}").first()[0]
        picked = [f"cast(if({test}, {new[f.name.lower()]}, `{f.name}`) AS {f.dataType.simpleString()}) AS `{f.name}`" if f.name.lower() in new else f"`{f.name}`" for f in df.schema.fields]
        self._new(name, self._plan(f"SELECT {', '.join(picked)} FROM {name}"), self.tables[name].defaults)
        return self._count(n)

    def _delete(self, items: list) -> DataFrame:
        where = next((i for i, x in enumerate(items) if key(x) == "where"), len(items))
        name = self._name(items[2:where])
        test = f"coalesce({Rewriter(self._file, self._asof).expr(items[where + 1 :])}, false)" if where < len(items) else "true"
        n = self._plan(f"SELECT count_if({test}) FROM {name}").first()[0]
        self._new(name, self._plan(f"SELECT * FROM {name} WHERE NOT {test}"), self.tables[name].defaults)
        return self._count(n)

    def _alter(self, items: list) -> DataFrame:
        at = next(i for i, x in enumerate(items) if key(x) in ("add", "drop", "rename", "alter"))
        name, what, rest = self._name(items[:at]), key(items[at]), [x for x in items[at + 1 :] if key(x) not in ("column", "if", "exists")]
        df, defaults = self._frame(name), dict(self.tables[name].defaults)
        if what == "add":
            end = next((i for i, x in enumerate(rest) if key(x) in ("default", "not", "null")), len(rest))
            value = next((Rewriter().expr(rest[i + 1 :]) for i, x in enumerate(rest) if key(x) == "default"), "null")
            column, kind = rest[0].text.strip('"'), Rewriter().type(rest[1:end])
            if value != "null":
                defaults[column.lower()] = value
            df = df.withColumn(column, F.expr(value).cast(kind))
        elif what == "drop":
            df = df.drop(rest[0].text.strip('"'))
        elif what == "rename" and key(rest[0]) == "to":
            self.spark.catalog.dropTempView(name)
            self._register(rest[1].text.lower(), self.tables.pop(name))
            return self._message("renamed")
        elif what == "rename":
            df = df.withColumnRenamed(rest[0].text.strip('"'), rest[-1].text.strip('"'))
        else:
            column, words = rest[0].text.strip('"'), [key(x) for x in rest[1:]]
            if "type" in words:
                df = df.withColumn(column, F.col(column).cast(Rewriter().type(rest[words.index("type") + 2 :])))
            elif words[:2] == ["set", "default"]:
                self.tables[name].defaults[column.lower()] = Rewriter().expr(rest[3:])
                return self._message("altered")
            else:
                if words[:2] == ["drop", "default"]:
                    self.tables[name].defaults.pop(column.lower(), None)
                return self._message("altered")
        self._new(name, df, defaults)
        return self._message("altered")

    def _copy(self, items: list) -> DataFrame:
        at = next(i for i, x in enumerate(items) if key(x) in ("to", "from"))
        path = items[at + 1].text[1:-1]
        options = {}
        group = next((x for x in items[at + 2 :] if isinstance(x, Group)), None)
        for part in split(group.items, ",") if group else []:
            if part:
                options[part[0].text.lower()] = part[1].text.strip("'") if len(part) > 1 else "true"
        kind = options.get("format", "").lower() or None
        if key(items[at]) == "to":
            df = self._query(items[0].items) if isinstance(items[0], Group) else self.spark.table(self._name(items[:1]))
            files.write(df, path, kind, options)
            back = files.read(self.spark, path, kind, options)  # what was written is counted, the query runs once
            return self._count(back.count())
        name = self._name([items[0]])
        table, fields = self.tables[name], self._frame(name).schema
        new = files.read(self.spark, path, kind, options, fields if (kind or "csv") == "csv" and not path.endswith(".parquet") else None)
        new.toDF(*fields.names).select(*[F.col(f.name).cast(f.dataType) for f in fields]).write.mode("append").parquet(table.path)
        self._register(name, table)
        return self._count(new.count())

    # the whole database

    def save(self, folder: str) -> None:
        """Each table as Parquet, and the catalog as one JSON row."""
        for name in self.tables:
            self._frame(name).write.mode("overwrite").parquet(f"{folder}/{name}")
        catalog = {"tables": {n: [t.schema, t.defaults] for n, t in self.tables.items()}, "sequences": {n: vars(s) for n, s in self.sequences.items()}}
        self.spark.createDataFrame([(json.dumps(catalog),)], "value string").write.mode("overwrite").text(f"{folder}/catalog.json.txt")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Engine:
        engine = cls(spark)
        catalog = json.loads(spark.read.text(f"{folder}/catalog.json.txt").first()[0])
        for name, (schema, defaults) in catalog["tables"].items():
            engine._new(name, spark.read.schema(schema).parquet(f"{folder}/{name}"), defaults)
        engine.sequences = {n: Sequence(**s) for n, s in catalog["sequences"].items()}
        return engine

    open = load


def _refers(items: list, name: str) -> bool:
    return any(_refers(x.items, name) if isinstance(x, Group) else key(x) == name for x in items)


def _renamed(items: list, name: str, view: str) -> list:
    """References to a table by another name, under the old one as an alias."""
    out, source = [], False
    for i, x in enumerate(items):
        if isinstance(x, Group):
            out.append(Group(x.open, _renamed(x.items, name, view)))
            continue
        k, after = key(x), items[i + 1] if i + 1 < len(items) else None
        source = k == "from" or source and k not in CLAUSES and k not in ("group", "order")
        if k == name and source and key(items[i - 1]) in ("from", "join", ",") and key(after) != ".":
            alias = isinstance(after, Word) and (key(after) == "as" or after.kind == "w" and key(after) not in ENDS)
            out += [Word(view, "w"), *([] if alias else [Word("AS", "w"), x])]
        else:
            out.append(x)
    return out


__all__ = ["Engine", "Result"]
