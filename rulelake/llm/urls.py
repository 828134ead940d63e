"""URL filters by a sort-merge range join with a stack of nested rules.

A host's canonical key is its text reversed, with a dot at the end: `www.example.net` is `ten.elpmaxe.www.`.
A rule's host covers itself and its subdomains, which are the keys that begin with the rule's own key, and so
one interval of the sorted keys; two such intervals are nested or apart. Pages and rules are sorted together
by key, and one sweep keeps the rules that are open as a stack: a rule opens at its key and closes at the first
key that does not begin with it.

The sort is cut into ranges at keys of a bounded sample of the pages, with the path and a salt as further sort keys, so
that a host, or a single address, that holds a third of all pages spans as many ranges as its share. A rule
goes to every range that its interval meets: one each for most rules, and at the cuts as many as are
nested there.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Sampled pages for each range of the sort.
SAMPLE = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """(host, path): from after the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; then to `?`, `#` or the end.
    Both are empty for a null and where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.reverse(host), F.lit("."))


class Stack:
    """The open rules of a sweep: one entry a host, the outermost first, with the host's rules by their paths."""

    def __init__(self):
        self.open: list[tuple[str, dict[str, tuple[str, str, str]], list[int]]] = []

    def move(self, key: str) -> None:
        """Close the rules whose interval ends before a key."""
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def add(self, key: str, host: str, path: str, verdict: str) -> None:
        self.move(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, {}, []))
        _, paths, lengths = self.open[-1]
        # of two rules of one host and path, block is the safer; so the order of rules does not matter
        paths[path] = min((host, path, verdict), paths.get(path, (host, path, verdict)), key=lambda r: r[2] != "block")
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def longest(self, key: str, path: str) -> tuple[str, str, str] | None:
        """The rule of most characters in host and path that fits; of equals that of the longer host."""
        self.move(key)
        best, size = None, -1
        for own, paths, lengths in reversed(self.open):  # the longest host first
            n = next((n for n in lengths if n <= len(path) and path[:n] in paths), None)
            if n is not None and len(own) + n > size:
                best, size = paths[path[:n]], len(own) + n
        return best


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """``<id_col>, <url_col>, host, path, rule, verdict`` of every page; one row for each row of pages.

    rules(host, path, verdict): a rule fits its host and all subdomains of it where the page's path begins with the rule's (an
    empty one always does). The longest rule that fits decides, by characters of host and path (a tie goes to the longer
    host, of equal rules to block); `rule` is its host and path, null where none fits and `default` decides.
    Rules with a null or empty host fit nothing, a null path is empty, a null verdict is block; hosts are compared in lower case. Pages without a host, nulls among them, fit no
    rule. Other columns of pages are left out; ids may be null or repeat. Tables may be empty.

    ranges: parts of the sort (default: spark.sql.shuffle.partitions). A task holds the rules of the hosts on one stack.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(f"`{url_col}`"))
    slim = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), host.alias("host"), path.alias("path"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    slim = slim.withColumn("key", host_key(F.col("host")))
    kept = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("verdict", F.lit("block")).alias("verdict")).where("host != ''")
    sample = slim.select("key", "path", "salt").orderBy(F.xxhash64("salt"), "salt").limit(SAMPLE * ranges).collect()
    sample = sorted((r.key, r.path, r.salt) for r in sample)
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(cuts, x) for x in zip(*(batch.column(k).to_pylist() for k in (4, 2, 3)))]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(batch.column(k) for k in (4, 0, 1, 2, 3, 5))], ["range", "key", "id", "host", "path", "salt", "url"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rules once for each range that their interval meets: a key that begins with `x.` lies from there to before `x/`."""
        for batch in batches:
            keys = batch.column(0).to_pylist()
            spans = [(bisect_right(cuts, (k, "", -(1 << 63))), bisect_right(cuts, (k[:-1] + "/", "", -(1 << 63)))) for k in keys]
            which = pa.array([n for n, (a, b) in enumerate(spans) for _ in range(a, b + 1)], pa.int64())
            at = pa.array([r for a, b in spans for r in range(a, b + 1)], pa.int32())
            yield pa.RecordBatch.from_arrays([at, *(c.take(which) for c in batch.columns)], ["range", "key", "host", "path", "verdict"])

    kind = slim.schema["id"].dataType.simpleString()
    mine = slim.select("id", "host", "path", "salt", "key", "url").mapInArrow(place, f"range int, key string, id {kind}, host string, path string, salt long, url string")
    theirs = kept.select(host_key(F.col("host")).alias("key"), "host", "path", "verdict").mapInArrow(spread, "range int, key string, host string, path string, verdict string")
    both = mine.withColumns({"kind": F.lit(1), "verdict": F.lit(None).cast("string")}).unionByName(theirs.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    columns = ["range", "key", "kind", "id", "url", "host", "path", "verdict"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack, last, found = None, Stack(), None, None
        for batch in batches:
            keep, rule_of, verdicts = [], [], []
            for i, (part, key, kind, host, path, verdict) in enumerate(zip(*(batch.column(columns.index(c)).to_pylist() for c in ("range", "key", "kind", "host", "path", "verdict")))):
                if part != now:
                    now, stack, last = part, Stack(), None
                if kind == 0:
                    stack.add(key, host, path, verdict)
                    last = None
                    continue
                if last != (key, path):
                    last, found = (key, path), stack.longest(key, path)
                keep.append(i)
                rule_of.append(found and found[0] + found[1])
                verdicts.append(found[2] if found else default)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)).take(at) for c in ("id", "url", "host", "path")), pa.array(rule_of, pa.string()), pa.array(verdicts, pa.string())], ["id", "url", "host", "path", "rule", "verdict"])
        give_back()

    # ranges are dealt by their number and sorted inside; pages of one address stand in the order of their salt, rules before pages
    swept = both.select(*columns, "salt").repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "key", "kind", "path", "salt").select(*columns)
    out = swept.mapInArrow(sweep, f"id {kind}, url string, host string, path string, rule string, verdict string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path", "rule", "verdict")


#: The rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_urls(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page; where no rule fits, allow."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules).select("page_id", "host", "path", "rule", "verdict")


OP11_SQL = f"""
with r(h, p, v) as (values {', '.join(str(r) for r in RULES)}),
u as (select page_id, row_number() over () as n, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
k as (select page_id, n, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') as host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from u),
m as (select n, arg_max(h || p, length(h || p) * 1000 + length(h)) as rule, arg_max(v, length(h || p) * 1000 + length(h)) as verdict from k join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by n)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from k left join m using (n)"""
