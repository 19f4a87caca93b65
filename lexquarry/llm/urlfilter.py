"""URL filters over sorted arrays of rule digests.

A rule is a host with a path prefix and an action. Rules, and the strings that could be one (every suffix of a url's host
with every prefix of its path that is as long as a rule's), are dealt into groups by hash. A group's rules are one array
of 64-bit xxhash keys in order beside their full strings; a task maps its file into memory and probes it by vectorised
binary search. A hit counts only if the stored string is equal. The number of groups follows from the bytes of rules and
urls alone, so lists of any length go the same way.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm.common import ASCII_LOWER, ASCII_UPPER, fresh, materialize, table, unclashed

#: Bytes of strings, rules and probes, that one task holds, about.
GROUP_BYTES = 32_000_000
#: Bytes of rules that fit some url, counted, up to which they are sent to all tasks.
SENT_BYTES = 2_000_000
#: Rules of the production query, as stated for it: action and host/path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: The method's own list, for urls that no rule fits, is of the hosts that name themselves: those with one of these words as
#: a part of a label, on whatever domain.
BLOCKED_WORDS = ["ads", "adult", "bet", "bets", "casino", "pills", "poker", "porn", "slots", "spam", "viagra", "xxx"]
_TELLING = rf"(^|\.)((?:[^.]*-)?(?:{'|'.join(BLOCKED_WORDS)})(?:-[^.]*)?\..+)$"


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, with A-Z in lower case; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


class DigestArray:
    """Sorted keys in a memory-mapped file; the strings and values that belong to them in others."""

    def __init__(self, folder: str, name: str):
        self.keys = np.load(f"{folder}/{name}.keys.npy", mmap_mode="r")
        self.ends = np.load(f"{folder}/{name}.ends.npy", mmap_mode="r")
        self.text = np.load(f"{folder}/{name}.text.npy", mmap_mode="r")

    @staticmethod
    def write(strings: list[str], folder: str, name: str) -> None:
        data = [s.encode() for s in strings]
        keys = np.array([xxhash.xxh64_intdigest(d) for d in data], np.uint64)
        order = np.argsort(keys, kind="stable")
        data = [data[i] for i in order]
        parts = {"keys": keys[order], "ends": np.cumsum([len(d) for d in data], dtype=np.int64), "text": np.frombuffer(b"".join(data), np.uint8)}
        for part, value in parts.items():
            np.save(f"{folder}/{name}.{part}.npy", value)

    def string(self, i: int) -> bytes:
        return self.text[self.ends[i - 1] if i else 0 : self.ends[i]].tobytes()

    def find(self, probes: list[bytes]) -> np.ndarray:
        """The place of each probe's own string, or -1."""
        out = np.full(len(probes), -1)
        if not len(self.keys):
            return out
        keys = np.array([xxhash.xxh64_intdigest(p) for p in probes], np.uint64)
        at = np.searchsorted(self.keys, keys)
        near = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys)
        for i in near.tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:  # strings whose keys collide stand side by side
                if self.string(j) == probes[i]:
                    out[i] = j
                    break
                j += 1
        return out


def probe(asked: pd.DataFrame, rules: pd.DataFrame) -> pd.DataFrame:
    """The rows of rules whose rule is among those asked for."""
    if not len(asked) or not len(rules):
        return rules[:0]
    rules = rules.drop_duplicates("rule")
    with tempfile.TemporaryDirectory(prefix="spark-rules-") as folder:  # the task's own: written, mapped and gone
        DigestArray.write(rules["rule"].tolist(), folder, "rules")
        held = DigestArray(folder, "rules")
        found = held.find([r.encode() for r in asked["rule"]])
        hit = [held.string(i).decode() for i in np.unique(found[found >= 0]).tolist()]
        del held
    return rules[rules["rule"].isin(hit)]


def fits(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """h, p and fits (array of rule, given, listed) of the different hosts and paths (h, p) in urls that some rule fits.

    rules: rule (host/path, or a bare host for any path), given, listed. A rule without host, or null, never fits.
    """
    frame = rules.where("rule is not null and rule <> '' and not startswith(rule, '/')")
    frame = materialize(frame.groupBy("rule").agg(F.bool_or("given").alias("given"), F.bool_or("listed").alias("listed")), "rules")
    depth = F.when(F.contains("rule", F.lit("/")), F.length("rule") - F.instr("rule", "/") + 1).otherwise(0)
    depths = [r[0] for r in frame.select(depth).distinct().collect()]  # at most as many as paths are long
    asked = materialize(urls.where(F.col("h") != "").select("h", "p").distinct(), "hosts")
    labels = F.split("h", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = asked.select("h", "p", F.explode(hosts).alias("s")).select("h", "p", "s", F.explode(F.array(*map(F.lit, depths)).cast("array<int>")).alias("d"))
    each = each.where(F.length("p") >= F.col("d")).select("h", "p", F.concat("s", F.substring("p", F.lit(1), F.col("d"))).alias("rule"))
    wanted = materialize(each.select("rule").distinct(), "probes")
    size = sum(df.agg(F.sum(F.octet_length("rule"))).first()[0] or 0 for df in (frame, wanted))
    group = F.pmod(F.xxhash64("rule"), F.lit(-(-size // GROUP_BYTES) or 1))
    hits = wanted.groupBy(group).cogroup(frame.groupBy(group)).applyInPandas(probe, "rule string, given boolean, listed boolean")
    hits = materialize(hits, "hits")
    few = (hits.agg(F.sum(F.octet_length("rule") + 32)).first()[0] or 0) <= SENT_BYTES
    # Spark takes each for as large as the compressed file that it is made of, and would send all its rows through the driver.
    hits = F.broadcast(hits) if few else hits.hint("merge")
    return each.join(hits, "rule").groupBy("h", "p").agg(F.collect_list(F.struct("rule", "given", "listed")).alias("fits"))


def blocked_hosts(pages: DataFrame, url: str = "url") -> DataFrame:
    """rule: the hosts in pages that name themselves by one of BLOCKED_WORDS, from that label on."""
    return pages.select(F.regexp_extract(host_of(F.col(url)), _TELLING, 2).alias("rule")).where("rule <> ''").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str]], blocked: list[str] | DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict (names are renamed if taken): a fitting rule's action, else block for
    hosts on the method's list and their subdomains, else allow. The longest rule that fits counts; of equal length, the
    first in order of strings. Null url, or one without ://: empty host and path, allow."""
    spark: SparkSession = pages.sparkSession
    names = {c: unclashed(pages, c) for c in ("host", "path", "rule", "verdict")}
    listed = blocked if isinstance(blocked, DataFrame) else spark.createDataFrame([(b,) for b in blocked], "rule string")
    given = spark.createDataFrame([(r,) for _, r in rules], "rule string")
    both = given.select("rule", F.lit(True).alias("given"), F.lit(False).alias("listed")).unionByName(listed.select("rule", F.lit(False).alias("given"), F.lit(True).alias("listed")))
    work = pages.withColumn(names["host"], host_of(F.col(url))).withColumn(names["path"], path_of(F.col(url)))
    found = fits(work.select(F.col(names["host"]).alias("h"), F.col(names["path"]).alias("p")), both)
    mine = {c: fresh(work, c) for c in ("h", "p", "fits")}
    found = found.select(*(F.col(c).alias(n) for c, n in mine.items()))
    work = work.join(found, (work[names["host"]] == found[mine["h"]]) & (work[names["path"]] == found[mine["p"]]), "left")
    own = F.filter(mine["fits"], lambda x: x["given"])
    best = F.array_min(F.transform(own, lambda x: F.struct((-F.length(x["rule"])).alias("n"), x["rule"].alias("rule"))))["rule"]
    work = work.withColumn(names["rule"], best)
    actions = F.create_map(*(F.lit(x) for action, r in rules for x in (r, action))) if rules else None
    action = F.try_element_at(actions, F.col(names["rule"])) if rules else F.lit(None).cast("string")
    bad = F.coalesce(F.exists(mine["fits"], lambda x: x["listed"]), F.lit(False))
    return work.withColumn(names["verdict"], F.coalesce(action, F.when(bad, "block").otherwise("allow"))).drop(*mine.values())


def op3(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES, blocked_hosts(pages)).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{action}', '{rule[: rule.index('/')]}', '{rule[rule.index('/') :]}', '{rule}')" for action, rule in RULES)
SQL = rf"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{ASCII_UPPER}', '{ASCII_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(action, h, p, rule) AS (VALUES {_VALUES}),
blocked AS (SELECT DISTINCT regexp_extract(host, '{_TELLING}', 2) AS h FROM parts WHERE regexp_matches(host, '{_TELLING}')),
fits AS (
  SELECT page_id, arg_min(rule, (-length(rule), rule)) AS rule, arg_min(action, (-length(rule), rule)) AS action
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT parts.page_id, host, path, rule,
       coalesce(action, CASE WHEN EXISTS (SELECT 1 FROM blocked WHERE host = h OR ends_with(host, '.' || h)) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (page_id)
"""
