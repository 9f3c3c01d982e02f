"""URL filters: nested host rules as intervals of reversed-host keys, matched by one sorted sweep.

Hosts turn into keys of their labels in reverse (`a.example.net` -> `net.example.a.`, with the
lowest byte in place of the dot), so a rule's host and all its subdomains are one interval. Rows are
cut into ranges of the key at bounds from a bounded sample of hosts; a rule goes to every
range that its interval meets. Each range is sorted once and swept: the stack holds the rules whose
intervals are open, and as intervals nest, the top is always the narrowest host.

A null url, or one without `://`, has an empty host and path and no rule. The host is what follows the
first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; the path is what follows up to `?`, `#` or the
end. A rule fits its host and all subdomains if the path starts with the rule's path. The rule with the
longest host and path wins; of equal ones `block` wins. Repeated rows keep their own results.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of

#: (verdict, host, path prefix); production rules of the query
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
LOW = "\x01"
#: rows read for the range bounds, at least and for each range; they only decide how evenly the ranges are filled
BOUND_ROWS = 4_000
ROWS_PER_RANGE = 20
#: characters of a bound
BOUND_CHARS = 400


def host_and_path(url: str = "url"):
    """Columns for the host (A-Z lower-cased) and the path of a url."""
    raw = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    lower = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    empty = F.lit("")
    return F.coalesce(lower, empty), F.coalesce(path, empty)


def host_key(host: str) -> str:
    return LOW.join(reversed(host.split("."))) + LOW


def _sweep(rules: Sequence[tuple[str, str, str]], default: str):
    """Rows sorted by key, rules (rank of rule in `rule_no`) before the rows of the same key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, list[int]]] = []
        part = None
        for batch in batches:
            ids, hosts, paths, keys, numbers, parts = (batch.column(k) for k in range(6))
            keep, found, verdicts = [], [], []
            for k, (key, number, path, own) in enumerate(
                zip(keys.to_pylist(), numbers.to_pylist(), paths.to_pylist(), parts.to_pylist(), strict=True)
            ):
                if own != part:
                    stack, part = [], own
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if number >= 0:
                    if stack and stack[-1][0] == key:
                        stack[-1][1].append(number)
                    else:
                        stack.append((key, [number]))
                    continue
                fits = [n for _, opened in stack for n in opened if path.startswith(rules[n][2])]
                best = max(fits, key=lambda n: (len(rules[n][1] + rules[n][2]), rules[n][0] == "block"), default=None)
                keep.append(k)
                found.append(None if best is None else rules[best][1] + rules[best][2])
                verdicts.append(default if best is None else rules[best][0])
            at = pa.array(keep, pa.int64())
            columns = [ids.take(at), hosts.take(at), paths.take(at), pa.array(found, pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages`."""
    spark = pages.sparkSession
    batches_of(spark)
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    host, path = host_and_path()
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    reverse = F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), LOW), F.lit(LOW))
    # a hash of the row and its partition splits a host, or copies of a row, over several ranges
    rows = rows.withColumn("key", reverse).withColumn("salt", F.hex(F.xxhash64("page_id", "path", F.spark_partition_id())))
    spread = F.concat("key", F.lit(LOW), "salt")
    wanted = max(BOUND_ROWS, ROWS_PER_RANGE * ranges)
    share = min(1.0, wanted / max(1, pages.select("url").count()))
    # each partition draws its share, whatever its rows are
    sample = rows.sample(share, seed=17).select(F.substring(spread, 1, BOUND_CHARS).alias("at"))
    order = sorted((r.at for r in sample.collect()), key=str.encode)
    bounds = sorted({order[len(order) * k // ranges] for k in range(1, ranges)} if order else set(), key=str.encode)
    encoded = [b.encode() for b in bounds]
    kind = rows.schema["page_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [bisect_right(encoded, s) for s in batch.column("spread").cast(pa.binary()).to_pylist()]
            columns = [*batch.columns[:4], pa.array([-1] * len(part), pa.int32()), pa.array(part, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "key", "rule_no", "part"])

    schema = f"page_id {kind}, host string, path string, key string, rule_no int, part int"
    urls = rows.select("page_id", "host", "path", "key", spread.alias("spread")).mapInArrow(place, schema)
    opened = []
    for number, (_, rule_host, _) in enumerate(rules):
        key = host_key(rule_host)
        first = bisect_right(encoded, key.encode())
        last = bisect_right(encoded, (key[:-1] + "\x02").encode())
        opened += [(key, number, part) for part in range(first, last + 1)]
    if opened:
        table = spark.createDataFrame(opened, "key string, rule_no int, part int")
        urls = urls.unionByName(table.withColumns({"page_id": F.lit(None).cast(kind), "host": F.lit(""), "path": F.lit("")}))
    placed = urls.repartitionById(ranges, "part").sortWithinPartitions("part", "key", F.col("rule_no").desc())
    schema = f"page_id {kind}, host string, path string, rule string, verdict string"
    return placed.mapInArrow(_sweep(tuple(rules), default), schema)



