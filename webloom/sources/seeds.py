"""What a crawl starts from: seed lists, robots.txt, fetchers, project files."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import schema
from webloom.config import AuditConfig
from webloom.functions import urls
from webloom.shared import written

from . import store


def seed_lines(text: DataFrame, column: str = "value") -> DataFrame:
    """url of each line that is not blank, with a scheme."""
    lines = text.select(F.explode(F.split(column, r"\r?\n")).alias("line"))
    return lines.where(F.trim(F.regexp_replace("line", r"\s", " ")) != "").select(urls.clean_seed(F.col("line")).alias("url"))


def read_seed_file(spark: SparkSession, path: str) -> DataFrame:
    return seed_lines(spark.read.text(path))


def seed_rows(seeds: Iterable[str]) -> tuple[list[str], list[str]]:
    """Normalised seeds, and those that are no URL; seeds keep their fragment."""
    good, bad = [], []
    for seed in seeds:
        seed = seed.strip()
        if seed:
            whole = seed if seed.startswith(("http://", "https://")) else f"https://{seed}"
            normal = urls.normalise(whole) if not set(whole.split("://", 1)[1].split("/")[0]) & set(" <>\\^|") else None
            (good if normal else bad).append(normal or whole)
    return good, bad


def robots_rules(text: str, user_agent: str) -> list[str]:
    """The Disallow values that hold for a user agent; each User-agent line starts anew who is meant."""
    agent, meant, rules = user_agent.lower(), False, []
    for raw in text.splitlines():
        line = raw.strip()
        directive, colon, value = line.partition(":")
        directive, value = directive.strip().lower(), value.strip()
        if not colon or line.startswith("#"):
            continue
        if directive == "user-agent":
            meant = value == "*" or value.lower() in agent
        elif directive == "disallow" and meant and value:
            rules.append(value)
    return rules


def robots_rules_table(text: DataFrame, user_agent: str) -> DataFrame:
    """The same over a table of robots files (host, value): host, rule."""
    agent = F.lit(user_agent.lower())
    lines = text.select("host", F.posexplode(F.split("value", r"\r?\n")).alias("at", "raw")).withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    split = lines.where((F.col("line") != "") & ~F.col("line").startswith("#") & F.col("line").contains(":")).select("host", "at", F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1))).alias("directive"), F.regexp_replace(F.regexp_extract("line", r"^[^:]*:(.*)$", 1), r"^\s+|\s+$", "").alias("value"))
    from pyspark.sql import Window

    group = F.last(F.when(F.col("directive") == "user-agent", F.lower("value")), ignorenulls=True).over(Window.partitionBy("host").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    meant = (F.col("agent") == "*") | agent.contains(F.col("agent"))
    return split.withColumn("agent", group).where((F.col("directive") == "disallow") & (F.col("value") != "") & F.coalesce(meant, F.lit(False))).select("host", F.col("value").alias("rule"))


#: A fetcher answers URLs, a partition at a time: dictionaries of schema.RESPONSE.
Fetcher = Callable[[Iterable[str]], Iterable[dict]]


def http_fetcher(config: AuditConfig, timeout: float = 10.0) -> Fetcher:
    """Plain GET of each URL; redirects are followed or reported, failures are rows."""

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *_):
            return None

    def fetch(targets):
        import time

        opener = urllib.request.build_opener(*([] if config.follow_redirects else [Stay]))
        for url in targets:
            began = time.monotonic()
            row = {"url": url, "status_code": None, "error_message": None, "content_type": None, "body": None}
            try:
                with opener.open(urllib.request.Request(url, headers={"User-Agent": config.user_agent}), timeout=timeout) as got:
                    row |= {"status_code": got.status, "content_type": got.headers.get("Content-Type"), "body": got.read()}
            except urllib.error.HTTPError as wrong:
                row |= {"status_code": wrong.code, "error_message": f"{wrong.code} {wrong.reason}", "content_type": wrong.headers.get("Content-Type")}
            except (OSError, ValueError) as wrong:
                row["error_message"] = f"Network Error: {wrong}"
            row["response_time_ms"] = int((time.monotonic() - began) * 1000)
            yield row

    return fetch


def rendering(fetcher: Fetcher, render: Callable[[str, str], str]) -> Fetcher:
    """A fetcher whose bodies pass through a renderer (url, html); one that fails leaves the body as it is."""

    def fetch(targets):
        for row in fetcher(targets):
            if row.get("body"):
                try:
                    row = row | {"body": render(row["url"], row["body"].decode("utf-8", "replace")).encode()}
                except Exception:  # noqa: BLE001  a renderer is not ours
                    pass
            yield row

    return fetch


def fetch_with(frontier: DataFrame, fetcher: Fetcher) -> DataFrame:
    """schema.RESPONSE of each URL of a frontier."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema.RESPONSE)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{n: row.get(n) for n in arrow.names} for row in fetcher(batch.column(0).to_pylist())], arrow)

    return frontier.select("url").mapInArrow(run, schema.RESPONSE)


def pages_as_responses(pages: DataFrame) -> DataFrame:
    """The offline fetcher: stored pages (url, html) as responses, by a join with the frontier."""
    return pages.select(F.regexp_replace("url", "#.*$", "").alias("url"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("error_message"), F.lit("text/html").alias("content_type"), F.encode("html", "UTF-8").alias("body"), F.lit(0).cast("long").alias("response_time_ms"))


# Project files.

#: What stands between two records of a project that is indented by two spaces, before the first and after the last.
BETWEEN, BEFORE, AFTER = "\n    },\n    {\n", '\n  "results": [\n    {\n', "\n    }\n  ],\n"
_HEAD, _RESULTS, _TAIL = '{"seed_url": ', '"results": [', '], "stats": '


def _head_of(document: str) -> tuple[str, AuditConfig, dict]:
    try:
        whole = json.loads(document)
        return whole["seed_url"], AuditConfig.from_json(json.dumps(whole["config"])), whole.get("stats") or {}
    except (ValueError, KeyError, TypeError):
        raise ValueError("Failed to open project file.") from None


def read_project(spark: SparkSession, path: str) -> tuple[str, AuditConfig, DataFrame, dict]:
    """Seed, settings, results and stats of a project, a file or the folder of its parts; stats are those of the file.

    A project is read in splits that are cut at its records, so a task holds one record at a time: each is a line of its own as
    project_json writes it, or stands between two fixed lines where the document is indented. Any other layout is one row of one task.
    """
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith(_HEAD) & F.col("value").endswith(_RESULTS)).first()
    if head:
        tail = lines.where(F.col("value").startswith(_TAIL)).first()
        found = _head_of(head["value"] + (tail["value"] if tail else "]}"))
        rows = lines.where(F.col("value").startswith('{"url"') | F.col("value").startswith(',{"url"')).select(F.ltrim(F.col("value"), F.lit(",")).alias("record"))
    elif not lines.where(F.col("value") == '  "results": [').isEmpty():
        chunks = spark.read.option("lineSep", BETWEEN).text(path)
        first = chunks.where(F.col("value").contains(BEFORE)).first()["value"].partition(BEFORE)[0]
        last = chunks.where(F.col("value").contains(AFTER)).first()["value"].partition(AFTER)[2]
        found = _head_of(first + '\n  "results": [],\n' + last)
        own = F.substring_index(F.substring_index("value", BEFORE, -1), AFTER, 1)
        rows = chunks.select(F.concat(F.lit("{"), own, F.lit("}")).alias("record"))
    else:
        return _read_whole(spark, path)
    seed, config, stats = found
    return seed, config, rows.select(F.from_json("record", schema.CRAWL).alias("r")).select("r.*"), stats


def _read_whole(spark: SparkSession, path: str) -> tuple[str, AuditConfig, DataFrame, dict]:
    from pyspark.sql import types as T

    stats = T.StructType([T.StructField(f.name, f.dataType) for f in schema.STATS.fields])
    project = T.StructType([T.StructField("seed_url", T.StringType()), T.StructField("config", T.StringType()), T.StructField("results", T.ArrayType(schema.CRAWL)), T.StructField("stats", stats)])
    whole = spark.read.schema(project).option("multiLine", True).json(path)
    head = whole.select("seed_url", "config", "stats").first()
    if head is None or head["config"] is None:
        raise ValueError("Failed to open project file.")
    return head["seed_url"], AuditConfig.from_json(head["config"]), whole.select(F.inline("results")), head["stats"].asDict() if head["stats"] else {}


def project_json(results: DataFrame, seed: str, config: AuditConfig, stats: DataFrame) -> DataFrame:
    """The lines of a project's JSON, a record a line, in parts whose order is that of the document.

    The head has the first record; all others begin with a comma and may come in any order, so they are written where they are.
    """
    spark = results.sparkSession
    rows = written(results.select(F.monotonically_increasing_id().alias("at"), F.to_json(F.struct(*(f.name for f in schema.CRAWL.fields)), {"ignoreNullFields": "false"}).alias("value")), "project")
    first = rows.agg(F.min("at").alias("first"))
    opening = f"{_HEAD}{json.dumps(seed)}, \"config\": {config.to_json()}, {_RESULTS}"
    one = rows.agg(F.min_by("value", "at").alias("value"))
    head = one.select(F.explode(F.when(F.col("value").isNull(), F.array(F.lit(opening))).otherwise(F.array(F.lit(opening), F.col("value")))).alias("value"))
    rest = rows.join(F.broadcast(first), F.col("at") > F.col("first")).select(F.concat(F.lit(","), F.col("value")).alias("value"))
    tail = stats.select(F.concat(F.lit(_TAIL), F.to_json(F.struct("*")), F.lit("}")).alias("value"))
    return head.union(rest).union(tail)


def write_project(results: DataFrame, seed: str, config: AuditConfig, stats: DataFrame, path: str, file: str | None = None) -> None:
    """Writes a project in parts to a folder, and joins them to one file if that is named."""
    project_json(results, seed, config, stats).write.mode("overwrite").text(path)
    if file:
        join_parts(path, file)


def join_parts(path: str, file: str, step: int = 1 << 20) -> None:
    """One file of a folder's parts in their order, copied a step of bytes at a time."""
    source, _ = store.filesystem(path)
    target, name = store.filesystem(file)
    with target.open_output_stream(name) as out:
        for part in store.files_below(path, ".txt"):
            with source.open_input_stream(part) as got:
                while data := got.read(step):
                    out.write(data)


def models(catalogue: str) -> list[str]:
    """Sorted ids of a model catalogue's JSON."""
    return sorted(m["id"] for m in json.loads(catalogue).get("data", []) if isinstance(m.get("id"), str))


def fetch_models(fetcher: Fetcher, url: str) -> list[str]:
    """The models that a catalogue's address lists; none if it gives nothing that can be read."""
    got = next(iter(fetcher([url])), {})
    try:
        return models((got.get("body") or b"{}").decode("utf-8", "replace")) if got.get("status_code") == 200 else []
    except (ValueError, AttributeError):
        return []


def fetch_robots(fetcher: Fetcher, seed: str, user_agent: str) -> list[str]:
    """The rules of the robots.txt beside a seed; none if there is no such file."""
    got = next(iter(fetcher([urllib.parse.urljoin(seed, "/robots.txt")])), {})
    ok = 200 <= (got.get("status_code") or 0) < 300
    return robots_rules((got.get("body") or b"").decode("utf-8", "replace"), user_agent) if ok else []


def stored_fetcher(pages: DataFrame) -> Fetcher:
    """Stored pages (url, html) as a fetcher on the driver, for a few URLs."""

    def fetch(targets):
        for url in targets:
            row = pages_as_responses(pages).where(F.col("url") == url).first()
            yield row.asDict() if row else {"url": url, "status_code": None}

    return fetch


def suggest(requests: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """requests (prompt) with `suggestion`, asked for with a client of one's own."""
    import pyarrow as pa
    from pyspark.sql import types as T

    out = T.StructType([*requests.schema.fields, T.StructField("suggestion", T.StringType())])

    def run(batches):
        for batch in batches:
            asked = batch.column(batch.schema.get_field_index("prompt")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([client(p).strip() for p in asked], pa.string())], names=out.names)

    return requests.mapInArrow(run, out)
