"""Documentation: READMEs, links, community files and docstring coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import paths as P
from ..functions import text as T
from . import generic as G
from .languages import count_lines
from .quality import python_facts
from .structure import analyzed_files, classified

# Heading words of README sections, names of community files, site generators and badge hosts.
SECTIONS = {
    "install": ("install", "setup", "set up", "getting started", "quick start", "quickstart"),
    "usage": ("usage", "example", "how to use", "tutorial", "demo"),
    "configuration": ("config", "environment", "settings", "options"),
    "features": ("feature", "overview", "about", "introduction", "what is", "why"),
    "requirements": ("requirement", "prerequisite", "dependencies"),
    "testing": ("test", "testing"),
    "api": ("api", "reference", "documentation", "docs"),
    "deployment": ("deploy", "production", "hosting"),
    "contributing": ("contribut", "development", "developing"),
    "license": ("license", "licence"),
    "support": ("support", "faq", "troubleshoot", "help", "community"),
}
COMMUNITY = {
    "contributing": ("contributing",),
    "license": ("license", "licence", "copying"),
    "changelog": ("changelog", "changes", "history", "news", "releases"),
    "code_of_conduct": ("code_of_conduct", "code-of-conduct"),
    "security": ("security",),
    "support": ("support",),
    "governance": ("governance",),
    "maintainers": ("maintainers", "authors", "codeowners"),
}
DOC_DIRS = ("docs", "doc", "documentation", "website")
BADGE = r"shields\.io|badge|travis-ci|codecov\.io|circleci\.com/gh|github\.com/.*/workflows/|/actions/workflows/|badgen\.net|pepy\.tech"
MD_HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
MD_LINK = r'(!?)\[([^\[\]]*)\]\(\s*<?([^)\s>]+)>?(?:\s+"[^"]*")?\s*\)'
HTML_IMAGE = r"""(?i)<img\s[^>]*src=["']([^"']+)["']"""
HTML_LINK = r"""(?i)<a\s[^>]*href=["']([^"']+)["']"""
RST_UNDERLINE = r"""^([=\-~^"'`#*+])\1{2,}\s*$"""
#: Files at the root or in the documentation's directory that tell its generator, in order of priority.
SITE_GENERATORS = {
    "mkdocs.yml": "MkDocs", "mkdocs.yaml": "MkDocs", "docusaurus.config.js": "Docusaurus", "docusaurus.config.ts": "Docusaurus", "book.toml": "mdBook",
    ".readthedocs.yaml": "Read the Docs", ".readthedocs.yml": "Read the Docs", "antora.yml": "Antora", "_config.yml": "Jekyll",
    ".vitepress/config.ts": "VitePress", ".vitepress/config.js": "VitePress", "astro.config.mjs": "Astro/Starlight", "conf.py": "Sphinx",
}
MAX_HEADINGS, MAX_BROKEN = 40, 30


def known_paths(tree: DataFrame) -> DataFrame:
    """repo_id, path of files, links at the root and directories, those that only occur above a file included."""
    rows = classified(tree)
    files = analyzed_files(rows).select("repo_id", "path")
    links = rows.filter((F.col("type") == "symlink") & ~F.col("path").contains("/")).select("repo_id", "path")
    dirs = rows.filter("type = 'dir'").select("repo_id", "path").union(files.select("repo_id", F.explode(G.ancestors(F.col("path")))))
    return files.withColumn("kind", F.lit("file")).union(links.withColumn("kind", F.lit("link"))).union(dirs.withColumn("kind", F.lit("dir"))).distinct()


def readme_paths(known: DataFrame) -> DataFrame:
    """Each repository's README: at the root, else below .github, else below docs; Markdown first, then reStructuredText."""
    path = F.col("path")
    place = F.when(P.depth(path) == 1, 0).when(path.rlike(r"^\.github/[^/]+$"), 1).when(path.rlike(r"^docs/[^/]+$"), 2)
    rows = known.filter("kind <> 'dir'").filter(place.isNotNull() & (P.stem(path) == "readme"))
    low = F.lower(path)
    return G.cap_per_group(rows, ["repo_id"], [place, ~P.ends_with_any(low, (".md", ".markdown")), ~low.endswith(".rst"), "path"], 1).select("repo_id", "path")


def prose(readmes: DataFrame) -> DataFrame:
    """readmes(repo_id, path, text) a row a line outside fenced blocks: format, line, text, and the file's fenced blocks.
    A README's lines meet in one task; it has one a repository."""
    low = F.lower("path")
    kind = F.when(P.ends_with_any(low, (".md", ".markdown", ".mdx")), "markdown").when(low.endswith(".rst"), "rst").otherwise("text")
    lines = readmes.select("repo_id", "path", kind.alias("format"), F.posexplode(T.lines(F.col("text"))).alias("line", "text"))
    fence = (F.col("format") == "markdown") & F.regexp_replace("text", f"^{T.SPACE}+", "").rlike("^(```|~~~)")
    seen = F.sum(F.when(F.col("fence"), 1).otherwise(0)).over(W.partitionBy("repo_id", "path").orderBy("line"))
    marked = lines.withColumn("fence", fence).withColumn("seen", seen)
    return marked.withColumn("blocks", F.ceil(F.max("seen").over(W.partitionBy("repo_id", "path")) / 2)).filter((F.col("seen") % 2 == 0) & ~F.col("fence"))


def headings(lines: DataFrame) -> DataFrame:
    """repo_id, path, line, heading, in order; hash marks, and lines underlined by the next one."""
    w = W.partitionBy("repo_id", "path").orderBy("line")
    before = T.strip(F.lag("text").over(w))
    text = F.col("text")
    marked = F.when((F.col("format") == "markdown") & text.rlike(MD_HEADING), T.strip(F.regexp_replace(F.regexp_extract(text, MD_HEADING, 2), r"[*_`]|<[^>]+>|!\[[^\]]*\]\([^)]*\)", "")))
    under = F.when(((F.col("format") == "markdown") & text.rlike(r"^(=+|-+)\s*$") & ~text.rlike(MD_HEADING)) | ((F.col("format") == "rst") & text.rlike(RST_UNDERLINE)), before)
    found = lines.withColumn("heading", F.coalesce(marked, under)).filter(F.col("heading") != "")
    return G.cap_per_group(found.select("repo_id", "path", "line", "heading"), ["repo_id", "path"], ["line"], MAX_HEADINGS)


def targets(texts: DataFrame) -> DataFrame:
    """texts(repo_id, path, prose): a row a link or image: image boolean, url."""
    t = F.col("prose")
    kinds, urls = F.regexp_extract_all(t, F.lit(MD_LINK), F.lit(1)), F.regexp_extract_all(t, F.lit(MD_LINK), F.lit(3))
    pair = lambda image, url: F.struct(image.alias("image"), url.alias("url"))
    every = F.concat(F.zip_with(kinds, urls, lambda k, u: pair(k == "!", u)), F.transform(F.regexp_extract_all(t, F.lit(HTML_IMAGE), F.lit(1)), lambda u: pair(F.lit(True), u)), F.transform(F.regexp_extract_all(t, F.lit(HTML_LINK), F.lit(1)), lambda u: pair(F.lit(False), u)))
    return texts.select("repo_id", "path", F.posexplode(every).alias("ord", "t")).select("repo_id", "path", "ord", "t.*")


def broken_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """Relative targets that are neither a path nor a directory of the repository; '/' starts at its root."""
    url = F.col("url")
    bare = F.regexp_extract(url, "^([^?#]*)", 1)
    relative = links.filter(~url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#|^//") & (bare != "")).withColumn("target", T.percent_decode(bare))
    base = F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat_ws("/", F.when(P.parent(F.col("path")) != "", P.parent(F.col("path"))), F.col("target")))
    placed = relative.withColumn("resolved", T.normalized(base)).filter("resolved <> ''")
    lost = placed.join(known.select("repo_id", F.col("path").alias("resolved")).distinct(), ["repo_id", "resolved"], "left_anti")
    first = lost.groupBy("repo_id", "path", "target").agg(F.min("ord").alias("ord"))
    return G.cap_per_group(first, ["repo_id", "path"], ["ord"], MAX_BROKEN)


def readmes(tree: DataFrame, contents: DataFrame) -> DataFrame:
    """A row a repository with a README that was downloaded: measures, headings, sections and broken links."""
    known = known_paths(tree)
    own = contents.join(readme_paths(known), ["repo_id", "path"], "left_semi")
    lines = prose(own)
    heads = headings(lines).groupBy("repo_id", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "heading"))), lambda x: x["heading"]).alias("headings"))
    texts = lines.groupBy("repo_id", "path", "format", "blocks").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("prose"))
    links = targets(texts)
    counts = links.groupBy("repo_id", "path").agg(F.count_if(~F.col("image")).alias("links"), F.count_if("image").alias("images"), F.count_if(F.col("image") & F.col("url").rlike(BADGE)).alias("badges"))
    lost = broken_links(links, known).groupBy("repo_id", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "target"))), lambda x: x["target"]).alias("broken_relative_links"))
    sizes = own.select("repo_id", "path", F.octet_length("text").alias("bytes"), T.newline_count(F.col("text")).alias("lines"), F.regexp_count("text", F.lit(r"(?m)^\.\. code(?:-block)?::|::\s*$")).alias("rst_blocks"))
    keys = ["repo_id", "path"]
    joined = reduce(lambda a, b: a.join(b, keys, "left"), [sizes, texts, heads, counts, lost])
    low = F.transform(F.coalesce("headings", F.array().cast("array<string>")), F.lower)
    section = lambda words: F.exists(low, lambda h: reduce(lambda a, b: a | b, [h.contains(w) for w in words]))
    words = T.word_count(F.coalesce("prose", F.lit("")))
    return joined.select(*keys, "format", "bytes", "lines", words.alias("words"), (words / F.lit(float(C.WORDS_PER_MINUTE))).alias("reading_minutes"), F.col("headings"), *[section(w).alias(f"has_{k}") for k, w in SECTIONS.items()], F.when(F.col("format") == "markdown", F.col("blocks")).when(F.col("format") == "rst", F.col("rst_blocks")).otherwise(0).alias("code_blocks"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("links", "images", "badges")], F.exists(low, lambda h: h.isin("table of contents", "contents", "toc")).alias("has_table_of_contents"), "broken_relative_links")


def community_files(tree: DataFrame) -> DataFrame:
    """repo_id, key, path of the shallowest file of each kind at the root or one level below .github or docs."""
    path = F.col("path")
    known = known_paths(tree).filter("kind <> 'dir'").filter((P.depth(path) == 1) | path.rlike(r"^(\.github|docs)/[^/]+$"))
    key = reduce(lambda acc, kv: acc.when(P.stem(path).isin(*kv[1]), kv[0]), list(COMMUNITY.items())[1:], F.when(P.stem(path).isin(*COMMUNITY["contributing"]), "contributing"))
    shallow = G.cap_per_group(known.withColumn("key", key).filter("key is not null"), ["repo_id", "key"], [P.depth(path), "path"], 1).select("repo_id", "key", "path")
    every = known_paths(tree).filter("kind <> 'dir'")
    template = F.when(path.startswith(".github/ISSUE_TEMPLATE") | (F.lower(path) == ".github/issue_template.md"), "issue_templates").when(F.lower(P.name(path)) == "pull_request_template.md", "pr_template")
    return shallow.union(every.withColumn("key", template).filter("key is not null").groupBy("repo_id", "key").agg(F.min("path").alias("path")))


def directory_info(tree: DataFrame, candidates: tuple[str, ...] = DOC_DIRS) -> DataFrame:
    """repo_id, path, files and doc_files of the first of the candidate directories that a repository has."""
    known = known_paths(tree).filter("kind = 'dir'").filter(F.col("path").isin(*candidates))
    rank = F.array_position(F.array(*map(F.lit, candidates)), F.col("path"))
    chosen = G.cap_per_group(known.select("repo_id", "path"), ["repo_id"], [rank], 1)
    files = analyzed_files(classified(tree)).select("repo_id", F.element_at(P.segments(F.col("path")), 1).alias("top"), "category", P.depth(F.col("path")).alias("depth")).filter("depth > 1")
    inside = files.groupBy("repo_id", F.col("top").alias("path")).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("category") == "documentation").alias("doc_files"))
    return chosen.join(inside, ["repo_id", "path"], "left").fillna(0, ["files", "doc_files"])


def site_generators(tree: DataFrame) -> DataFrame:
    """repo_id, path (the documentation's directory) and generator of repositories whose documentation has one."""
    info = directory_info(tree).select("repo_id", F.col("path").alias("folder"))
    files = known_paths(tree).filter("kind <> 'dir'").join(info, "repo_id")
    inside = F.when(F.startswith(F.col("path"), F.concat("folder", F.lit("/"))), F.substring(F.col("path"), F.length("folder") + 2, F.length("path")))
    rank = F.array_position(F.array(*map(F.lit, SITE_GENERATORS)), F.coalesce(inside, F.col("path")))
    # a file at the root may lie in a folder of the same name as well
    told = files.withColumn("rank", F.when(rank > 0, rank).otherwise(F.array_position(F.array(*map(F.lit, SITE_GENERATORS)), F.col("path")))).filter("rank > 0")
    first = G.cap_per_group(told, ["repo_id"], ["rank"], 1)
    return first.select("repo_id", F.col("folder").alias("path"), F.element_at(F.array(*map(F.lit, SITE_GENERATORS.values())), F.col("rank").cast("int")).alias("generator"))


def comment_density(contents: DataFrame) -> DataFrame:
    """Comment lines over comment and code lines of source files; null without either."""
    path = F.col("path")
    rows = contents.filter(P.category(path) == "source").select("repo_id", count_lines(F.col("text"), P.classified_language(path)).alias("n"))
    out = rows.groupBy("repo_id").agg(F.sum("n.comment").alias("comment"), F.sum("n.code").alias("code"))
    some = F.col("comment") + F.col("code")
    return out.select("repo_id", (F.col("comment") / F.when(some > 0, some)).alias("comment_density"))


def docstring_coverage(contents: DataFrame) -> DataFrame:
    facts = python_facts(contents.filter(P.category(F.col("path")) == "source")).filter("parsed")
    out = facts.groupBy("repo_id").agg(F.sum("public").alias("public_definitions"), F.sum("documented").alias("documented"), F.count(F.lit(1)).alias("files_analyzed")).filter("public_definitions > 0")
    return out.withColumn("percent", F.lit(100.0) * F.col("documented") / F.col("public_definitions"))


def is_badge(url: Column) -> Column:
    return url.rlike(BADGE)
