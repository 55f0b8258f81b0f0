"""What of a repository is downloaded: prioritized stages, turns over directories, byte budgets, and decoding.

Also the keys and metadata of repositories as their host gives them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import paths as P
from ..functions import text as T
from ..functions.values import once
from . import generic as G
from . import ordered
from .structure import analyzed_files, classified

# Names of the host's own pages, which no owner bears.
RESERVED = ("about", "apps", "collections", "contact", "customer-stories", "enterprise", "explore", "features", "issues", "login", "marketplace", "new", "notifications", "orgs", "pricing", "pulls", "search", "settings", "sponsors", "topics", "trending", "join", "site")
OWNER = r"^[A-Za-z0-9](?:[A-Za-z0-9]|-(?=[A-Za-z0-9])){0,38}$"
NAME = r"^[A-Za-z0-9._-]{1,100}$"


def repository_key(raw: Column) -> Column:
    """struct(owner, name, error) of an URL, an ssh address or owner/name; what follows the name is passed over. Its steps
    are found once a row each, whatever of them the next ones name."""

    def stated(value: Column) -> Column:
        web = value.contains("://") | F.lower(value).rlike(r"^(www\.)?github\.com/")
        scheme = F.lower(F.regexp_extract(value, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
        rest = F.regexp_replace(value, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
        ssh = F.regexp_extract(value, r"(?i)^git@github\.com:(\S+)$", 1)
        return once(F.struct(value.alias("value"), web.alias("web"), scheme.alias("scheme"), rest.alias("rest"), ssh.alias("ssh")), placed)

    def placed(x: Column) -> Column:
        place = F.lower(F.regexp_extract(x["rest"], "^([^/?#]*)", 1))
        path = F.when(x["ssh"] != "", x["ssh"]).when(x["web"], F.regexp_extract(x["rest"], r"^[^/?#]*([^?#]*)", 1)).otherwise(x["value"])
        parts = F.filter(F.split(path, "/"), lambda s: s != "")
        return once(F.struct(x["value"].alias("value"), x["scheme"].alias("scheme"), ((x["ssh"] == "") & x["web"]).alias("by_web"), place.alias("place"), parts.alias("parts")), named)

    def named(x: Column) -> Column:
        owner, name = F.try_element_at(x["parts"], F.lit(1)), F.regexp_replace(F.try_element_at(x["parts"], F.lit(2)), r"(?i)\.git$", "")
        return once(F.struct(x.alias("x"), owner.alias("owner"), name.alias("name")), judged)

    def judged(y: Column) -> Column:
        x, owner, name = y["x"], y["owner"], y["name"]
        error = (
            F.when(x["value"] == "", "empty")
            .when(F.length(x["value"]) > 512, "too long")
            .when(x["value"].rlike(r"[\s\x00-\x1f]"), "white space")
            .when(x["by_web"] & (x["scheme"] != "") & ~x["scheme"].isin("http", "https"), "scheme")
            .when(x["by_web"] & x["place"].rlike("[@:]") & F.regexp_replace(x["place"], "^.*@|:.*$", "").isin("github.com", "www.github.com"), "credentials or port")
            .when(x["by_web"] & ~x["place"].isin("github.com", "www.github.com"), "host")
            .when(F.size(x["parts"]) < 2, "no repository")
            .when(F.lower(owner).isin(*RESERVED) | ~owner.rlike(OWNER), "owner")
            .when(~name.rlike(NAME) | name.isin(".", ".."), "name")
        )
        return once(error, lambda e: F.struct(F.when(e.isNull(), owner).alias("owner"), F.when(e.isNull(), name).alias("name"), e.alias("error")))

    return once(T.strip(F.coalesce(raw, F.lit(""))), stated)


METADATA = "full_name string, html_url string, description string, homepage string, default_branch string, stargazers_count long, forks_count long, subscribers_count long, open_issues_count long, language string, license struct<spdx_id: string, name: string>, topics array<string>, size long, created_at string, updated_at string, pushed_at string, archived boolean, disabled boolean, fork boolean, is_template boolean, owner struct<login: string, type: string, avatar_url: string>"


def metadata(rows: DataFrame, body: str = "body") -> DataFrame:
    """A row a repository from its host's JSON. A license that isn't asserted is none; dates that can't be read are null."""
    j = rows.select(F.from_json(F.col(body), METADATA).alias("j")).select("j.*")
    spdx = F.when(F.col("license.spdx_id") != "NOASSERTION", F.col("license.spdx_id"))
    return j.select(F.lower("full_name").alias("repo_id"), "full_name", F.col("owner.login").alias("owner"), "html_url", "description", "homepage", "default_branch", F.coalesce("stargazers_count", F.lit(0)).alias("stars"), F.coalesce("forks_count", F.lit(0)).alias("forks"), F.coalesce("subscribers_count", F.lit(0)).alias("watchers"), F.coalesce("open_issues_count", F.lit(0)).alias("open_issues"), F.col("language").alias("primary_language"), spdx.alias("license_spdx"), F.when(spdx.isNotNull(), F.col("license.name")).alias("license_name"), F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), F.col("size").alias("size_kb"), *[F.try_to_timestamp(c).alias(c) for c in ("created_at", "updated_at", "pushed_at")], *[F.coalesce(c, F.lit(False)).alias(c) for c in ("archived", "disabled", "is_template")], F.coalesce("fork", F.lit(False)).alias("is_fork"), F.col("owner.type").alias("owner_type"))


def head_commit(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows(repo_id, body): sha and committed_at of the newest commit in the host's JSON. A date that can't be read is null; an
    answer without a proper sha is left out."""
    j = rows.select("repo_id", F.from_json(F.col(body), "sha string, commit struct<committer: struct<date: string>>").alias("j"))
    return j.filter(F.col("j.sha").rlike("^[A-Za-z0-9]+$")).select("repo_id", F.col("j.sha").alias("sha"), F.try_to_timestamp("j.commit.committer.date").alias("committed_at"))


def raw_tree(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows(repo_id, body): entries of a recursive tree listing in JSON, in order; for structure.sanitized."""
    entry = "tree array<struct<path: string, type: string, mode: string, size: long>>, truncated boolean, sha string"
    return rows.select("repo_id", F.from_json(F.col(body), entry).alias("j")).select("repo_id", F.posexplode("j.tree").alias("ord", "e")).select("repo_id", "ord", "e.*")


def linguist(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows(repo_id, body): language, bytes from a JSON map."""
    return rows.select("repo_id", F.explode(F.from_json(F.col(body), "map<string, bigint>")).alias("language", "bytes")).filter("bytes >= 0")


def selected(tree: DataFrame, most: int = 300, max_file_bytes: int = 400_000) -> DataFrame:
    """repo_id, path, size, rank: manifests, workspace files, top-level documents and configuration, each up to its cap, then
    source and test files by turns over directories, most files in all."""
    path = F.col("path")
    files = analyzed_files(classified(tree)).filter(F.col("size").between(1, max_file_bytes)).select("repo_id", "path", "size", "category", "auxiliary", "depth")
    stages = [
        (P.is_manifest(path), [F.col("auxiliary"), F.col("depth"), path], C.MAX_MANIFESTS),
        (P.name(path).isin(*C.WORKSPACE_FILES) & ~F.col("auxiliary"), [F.col("depth"), path], C.MAX_WORKSPACE),
        (P.is_top_level_doc(path), [path], C.MAX_DOCS),
        (P.is_security_config(path), [F.col("depth"), path], C.MAX_CONFIG),
    ]
    # a stage's cap counts files that an earlier one has taken
    parts = [G.cap_per_group(files.filter(f), ["repo_id"], order, cap, "turn").select("repo_id", "path", "size", "turn", F.lit(n).alias("stage"), F.lit("").alias("dir")) for n, (f, order, cap) in enumerate(stages)]
    early = G.cap_per_group(reduce(DataFrame.union, parts), ["repo_id", "path"], ["stage"], 1)
    rest = files.filter(F.col("category").isin("source", "test")).join(early.select("repo_id", "path"), ["repo_id", "path"], "left_anti").withColumn("dir", P.parent(path))
    turns = G.cap_per_group(rest, ["repo_id", "dir"], ["path"], most, "turn").select("repo_id", "path", "size", "turn", F.lit(len(stages)).alias("stage"), "dir")
    return G.cap_per_group(early.union(turns), ["repo_id"], ["stage", "turn", "dir", "path"], most, "rank").select("repo_id", "path", "size", "rank")


def within_budget(chosen: DataFrame, budget: int = 20_000_000) -> DataFrame:
    """chosen taken in order of rank as long as bytes are left; one too big is passed over."""
    return ordered.budgeted(chosen, "size", budget, ["rank"], ["repo_id"])


def decoded(files: DataFrame, content: str = "content", max_bytes: int = 400_000) -> DataFrame:
    """Binary files as text: those over max_bytes or with a zero byte near their start are left out; what isn't UTF-8 is
    replaced."""
    data = F.col(content)
    binary = F.position(F.lit(b"\x00"), F.substring(data, 1, C.SNIFF_BYTES)) > 0
    return files.filter((F.octet_length(data) <= max_bytes) & ~binary).withColumn("text", F.make_valid_utf8(data.cast("string"))).drop(content)


#: What can become of a selected file.
OUTCOMES = ("fetched", "skipped_too_large", "skipped_binary", "failed", "rate_limited", "budget_exhausted")


def fetch_stats(attempts: DataFrame) -> DataFrame:
    """attempts(repo_id, path, outcome, bytes), a row a selected file: how many came to what, bytes fetched, and whether a rate
    limit or the budget cut the download."""
    was = lambda o: F.col("outcome") == o
    counts = [F.count_if(was(o)).alias(o) for o in OUTCOMES[:4]]
    cut = [F.coalesce(F.bool_or(was(o)), F.lit(False)).alias(o) for o in OUTCOMES[4:]]
    return attempts.groupBy("repo_id").agg(F.count(F.lit(1)).alias("selected"), *counts, F.coalesce(F.sum(F.when(was("fetched"), F.col("bytes"))), F.lit(0)).alias("bytes_fetched"), *cut)


def document_links(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(repo_id, path, target): links at the root to documents, resolved to files of the same repository."""
    links = tree.filter((F.col("type") == "symlink") & ~F.col("path").contains("/") & P.stem(F.col("path")).isin(*C.DOC_STEMS)).select("repo_id", "path")
    placed = links.join(targets, ["repo_id", "path"]).withColumn("target", T.normalized(F.col("target"))).filter(P.is_safe(F.col("target")))
    return placed.join(tree.filter("type = 'file'").select("repo_id", F.col("path").alias("target")), ["repo_id", "target"], "left_semi").select("repo_id", "path", "target")


def report_notes(meta: DataFrame) -> DataFrame:
    """meta(repo_id, truncated_by_host, truncated_by_limit, budget_exhausted, rate_limited): partial and its notes."""
    note = lambda c, text: F.when(F.coalesce(F.col(c), F.lit(False)), text)
    notes = F.array_compact(F.array(note("truncated_by_host", "the host cut the file tree"), note("truncated_by_limit", "the file tree was cut at the limit"), note("budget_exhausted", "the byte budget was used up"), note("rate_limited", "downloads met a rate limit")))
    return meta.select("repo_id", (F.size(notes) > 0).alias("partial"), notes.alias("notes"))


def latest_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
