"""Security indicators: rules over lines, sensitive files, environment variables and hygiene of .gitignore.

All rules of a line are tried in one projection; there is no join of rules and lines. A rule's pattern is tried only on lines
that hold one of its literals, and texts and lines without any literal are left out first. What is shown of a secret is
redacted.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import paths as P
from ..functions import text as T
from ..functions.values import once
from . import generic as G
from .quality import source_lines
from .structure import analyzed_files, classified


class Rule(NamedTuple):
    id: str
    severity: str
    category: str
    confidence: str
    pattern: str
    languages: tuple[str, ...] = ()
    files: tuple[str, ...] = ()


# The rules' patterns, in the order in which findings are emitted.
PY, JS, CI = ("Python",), ("JavaScript", "TypeScript", "Vue", "Svelte"), (".github/workflows/",)
SECRETS = [
    Rule("secret.private-key", "high", "secret", "high", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("secret.aws-access-key", "high", "secret", "high", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    Rule("secret.github-token", "high", "secret", "high", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{60,255})\b"),
    Rule("secret.slack-token", "high", "secret", "high", r"\bxox[abposr]-[A-Za-z0-9-]{10,200}"),
    Rule("secret.stripe-live-key", "high", "secret", "high", r"\b(?:sk|rk)_live_[0-9A-Za-z]{20,200}\b"),
    Rule("secret.google-api-key", "medium", "secret", "high", r"\bAIza[0-9A-Za-z_\-]{35}\b"),
    Rule("secret.llm-api-key", "high", "secret", "high", r"\bsk-(?:ant-[A-Za-z0-9_\-]{20,200}|proj-[A-Za-z0-9_\-]{20,200}|[A-Za-z0-9]{20}T3BlbkFJ[A-Za-z0-9]{20})"),
    Rule("secret.npm-token", "high", "secret", "high", r"\bnpm_[A-Za-z0-9]{36}\b"),
    Rule("secret.sendgrid-key", "high", "secret", "high", r"\bSG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43}\b"),
    Rule("secret.connection-string", "medium", "secret", "medium", r"""\b(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|rediss|amqps?|mssql)://[^:\s/'"@]{1,64}:([^@\s/'"]{3,128})@([^:/\s'"]{1,253})"""),
]
ASSIGNMENT = r"""(?i)\b([\w.-]{0,40}(?:password|passwd|pwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|private[_-]?key)[\w.-]{0,20})["']?\s*[:=]\s*["']([^"'\s]{8,200})["']"""
PLACEHOLDER = r"(?i)(change.?me|your[_-]|example|sample|dummy|placeholder|xxx|\*\*\*|<[^>]*>|\$\{|\{\{|^test|fake|redacted|todo|none|null|secret$|password$|process\.env|os\.environ|getenv)"
LOCAL_HOST = r"(?i)^(?:localhost|127\.\d+\.\d+\.\d+|0\.0\.0\.0|\[::1\]|[a-z][\w-]*)$"
CODE = [
    Rule("code.python-eval", "medium", "dangerous-code", "medium", r"(?<![\w.])(?:eval|exec)\s*\(", PY),
    Rule("code.python-shell-true", "medium", "dangerous-code", "medium", r"subprocess\.\w+\([^)]*shell\s*=\s*True", PY),
    Rule("code.python-os-system", "low", "dangerous-code", "medium", r"\bos\.system\s*\(", PY),
    Rule("code.python-pickle", "medium", "dangerous-code", "medium", r"\b(?:pickle|cPickle|dill)\.loads?\s*\(", PY),
    Rule("code.python-yaml-load", "medium", "dangerous-code", "medium", r"\byaml\.load\s*\((?![^)]*(?:SafeLoader|safe_load|CSafeLoader))", PY),
    Rule("code.tls-verify-disabled", "medium", "insecure-transport", "medium", r"(?i)verify\s*=\s*False|rejectUnauthorized\s*:\s*false|InsecureSkipVerify\s*:\s*true|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['\"]?0|CURLOPT_SSL_VERIFYPEER\s*,\s*(?:false|0)|ssl_verify(?:_peer)?\s*[:=]\s*false"),
    Rule("code.js-eval", "medium", "dangerous-code", "medium", r"(?<![\w.$])eval\s*\(|\bnew\s+Function\s*\(", JS),
    Rule("code.js-inner-html", "low", "dangerous-code", "medium", r"dangerouslySetInnerHTML|\.(?:inner|outer)HTML\s*=(?!=)|v-html\s*=", (*JS, "HTML")),
    Rule("code.js-child-process", "low", "dangerous-code", "medium", r"\bchild_process\b[^\n]*\bexec(?:Sync)?\s*\(|\bexecSync\s*\(", JS),
    Rule("code.php-dangerous", "medium", "dangerous-code", "medium", r"(?<![\w>$])(?:eval|unserialize|shell_exec|passthru|system|exec)\s*\(", ("PHP",)),
    Rule("code.cors-wildcard", "low", "configuration", "medium", r"Access-Control-Allow-Origin['\"]?\s*[:,]\s*['\"]\*['\"]|allow_origins\s*=\s*\[\s*['\"]\*['\"]|origin\s*:\s*['\"]\*['\"]"),
    Rule("config.debug-enabled", "low", "configuration", "medium", r"^\s*DEBUG\s*=\s*True\b", files=("settings.py", "config.py", "production.py")),
    Rule("docker.curl-pipe-shell", "medium", "supply-chain", "medium", r"\b(?:curl|wget)\b[^\n|]*\|\s*(?:sudo\s+)?(?:ba|z)?sh\b"),
    Rule("ci.pull-request-target", "medium", "ci", "medium", r"^(?!\s*#).*\bpull_request_target\b", files=CI),
    Rule("ci.script-injection", "medium", "ci", "medium", r"\$\{\{\s*github\.event\.(?:issue|pull_request|comment|review|review_comment|discussion|pages|commits|head_commit)[\w.\[\]*]*\.(?:title|body|message|name|ref|label|email|head_ref)\s*\}\}", files=CI),
    Rule("ci.unpinned-action", "info", "ci", "medium", r"uses:\s*(?!actions/|github/|\./|docker://)[\w.-]+/[\w./-]+@(?![0-9a-f]{40}\b)\S+", files=CI),
    Rule("ci.write-all-permissions", "medium", "ci", "medium", r"permissions\s*:\s*write-all", files=CI),
]
OTHERS = [
    Rule("secret.generic-assignment", "medium", "secret", "low", ASSIGNMENT),
    Rule("transport.insecure-http", "low", "insecure-transport", "medium", r"\bhttp://([A-Za-z0-9.-]+)(?::\d+)?[^\s'\"<>)]*"),
    Rule("docker.unpinned-base-image", "low", "supply-chain", "high", r"(?i)^\s*FROM\s+(?:--platform=\S+\s+)?(\S+)(?:\s+AS\s+(\S+))?"),
    Rule("file.sensitive", "high", "sensitive-file", "medium", ""),
    Rule("env.client-exposed-secret", "medium", "env-exposure", "medium", ""),
    Rule("gitignore.env-not-excluded", "low", "gitignore", "medium", ""),
]
LITERAL = r"""\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|(?:^|\s)(?:#|//).*$"""
# The same for Java, which otherwise takes a stack frame a character of a quoted text; neither alternative gives back anything.
POSSESSIVE = LITERAL.replace(")*", ")*+")
SAFE_HOST = r"(?i)^(?:[A-Za-z0-9-]+|localhost|127\.\d+\.\d+\.\d+|0\.0\.0\.0|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+|[\w.-]*\.(?:local|localhost|test|example|invalid|internal)|(?:www\.)?example\.(?:com|org|net)|[\w.-]*w3\.org|[\w.-]*xmlsoap\.org|schemas\.[\w.-]+|purl\.org|json-schema\.org|[\w.-]*apache\.org|xml\.org|ns\.adobe\.com|[\w.-]*openxmlformats\.org|java\.sun\.com|xmlns\.[\w.-]+|host\.docker\.internal)$"
SENSITIVE = [
    (r"(^|/)\.env(\.(?!example$|sample$|template$|dist$|defaults?$|test$|ci$)[\w.-]+)?$", "Environment file committed", "high"),
    (r"(^|/)(id_rsa|id_dsa|id_ecdsa|id_ed25519)$", "SSH private key file committed", "high"),
    (r"(?i)\.(pem|key|p12|pfx|jks|keystore)$", "Key or certificate store committed", "medium"),
    (r"(^|/)(terraform\.tfstate(\.backup)?)$", "Terraform state committed", "high"),
    (r"(^|/)(\.htpasswd|\.pgpass|\.netrc|\.git-credentials|credentials\.json|service[-_]?account[\w-]*\.json)$", "Credentials file committed", "high"),
    (r"(?i)\.(sqlite3?|db)$", "Database file committed", "low"),
]
NAME = "([A-Z][A-Z0-9_]{1,80})"
ENV_USES = [rf"os\.environ(?:\.get)?\s*[\[(]\s*['\"]{NAME}['\"]", rf"os\.getenv\(\s*['\"]{NAME}['\"]", rf"process\.env\.{NAME}", rf"process\.env\[\s*['\"]{NAME}", rf"import\.meta\.env\.{NAME}", rf"System\.getenv\(\s*\"{NAME}\"", rf"ENV\[\s*['\"]{NAME}['\"]", rf"os\.Getenv\(\s*\"{NAME}\"", rf"env::var\(\s*\"{NAME}\""]
PUBLIC = ("NEXT_PUBLIC_", "VITE_", "REACT_APP_", "NUXT_PUBLIC_", "EXPO_PUBLIC_", "PUBLIC_", "GATSBY_")
SECRET_NAME = "SECRET|PASSWORD|PASSWD|PRIVATE|TOKEN|API_KEY|APIKEY|ACCESS_KEY|CREDENTIAL"
PUBLIC_OK = "PUBLISHABLE|PUBLIC_KEY|ANON_KEY|SITE_KEY|RECAPTCHA|MAPS|ANALYTICS"
SEVERITIES = ("high", "medium", "low", "info")


# Literals of which a line that a rule matches has one, in lower case. They are looked for before the pattern is tried.
NEEDS = {
    "secret.private-key": ("-----begin ",), "secret.aws-access-key": ("akia", "asia"), "secret.github-token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),
    "secret.slack-token": ("xox",), "secret.stripe-live-key": ("_live_",), "secret.google-api-key": ("aiza",), "secret.llm-api-key": ("sk-",), "secret.npm-token": ("npm_",),
    "secret.sendgrid-key": ("sg.",), "secret.connection-string": ("://",), "secret.generic-assignment": ("passw", "pwd", "secret", "key", "token"),
    "code.python-eval": ("eval", "exec"), "code.python-shell-true": ("subprocess.",), "code.python-os-system": ("os.system",), "code.python-pickle": ("pickle.load", "dill.load"),
    "code.python-yaml-load": ("yaml.load",), "code.tls-verify-disabled": ("verify", "rejectunauthorized", "node_tls_reject_unauthorized", "curlopt_ssl_verifypeer"),
    "code.js-eval": ("eval", "function"), "code.js-inner-html": ("dangerouslysetinnerhtml", "html"), "code.js-child-process": ("exec",),
    "code.php-dangerous": ("eval", "unserialize", "shell_exec", "passthru", "system", "exec"), "code.cors-wildcard": ("access-control-allow-origin", "allow_origins", "origin"),
    "config.debug-enabled": ("debug",), "docker.curl-pipe-shell": ("curl", "wget"), "ci.pull-request-target": ("pull_request_target",), "ci.script-injection": ("github.event.", "${{"),
    "ci.unpinned-action": ("uses:",), "ci.write-all-permissions": ("write-all",), "transport.insecure-http": ("http://",),
}


def literals() -> list[str]:
    """All of them, each once and none that holds another: whoever has none of these has no match of any rule."""
    every = sorted({x for need in NEEDS.values() for x in need}, key=lambda x: (len(x), x))
    return [x for i, x in enumerate(every) if not any(y in x for y in every[:i])]


def has_one(lowered: Column, of: tuple[str, ...] | list[str]) -> Column:
    return once(lowered, lambda low: reduce(lambda a, b: a | b, [low.contains(x) for x in of]))


def applies(rule: Rule, path: Column, language: Column) -> Column:
    if rule.files:
        return reduce(lambda a, b: a | b, [path.startswith(f) if f.endswith("/") else P.name(path).startswith(f) for f in rule.files])
    return F.coalesce(language.isin(*rule.languages), F.lit(False)) if rule.languages else F.lit(True)


def downgraded(severity: Column, in_test: Column) -> Column:
    """One level lower in tests, examples and the like."""
    lower = F.when(severity == "high", "medium").when(severity == "medium", "low").otherwise("info")
    return F.when(in_test, lower).otherwise(severity)


def hit(rule: Rule, severity: Column, n: int, sub: Column | int = 0) -> Column:
    return F.struct(F.lit(n).alias("emitted"), F.lit(sub).alias("sub") if isinstance(sub, int) else sub.alias("sub"), F.lit(rule.id).alias("rule"), severity.alias("severity"), F.lit(rule.confidence).alias("confidence"), F.lit(rule.category).alias("category"))


def matches(contents: DataFrame, width: int | None = None) -> DataFrame:
    """repo_id, path, line, rule, severity, confidence, category, in_test and raw line of all findings in lines; with width,
    in the first characters of each."""
    path = F.col("path")
    files = contents.withColumns({"category": P.category(path), "language": P.classified_language(path), "in_test": P.is_test(path) | P.is_auxiliary(path)}).filter(~F.col("category").isin("binary", "asset", "lockfile"))
    # most texts and most lines have none of the literals: they end here, before any pattern is tried
    every = literals()
    some = files.filter(has_one(F.lower("text"), every))
    # outer: else a filter before it would split every text once more
    lines = some.select("repo_id", "path", "category", "language", "in_test", F.posexplode_outer(T.lines(F.col("text"))).alias("line", "raw")).filter("line is not null").withColumns({"line": F.col("line") + 1, "raw": F.substring("raw", 1, width) if width else F.col("raw")})
    lines = lines.withColumn("low", F.lower("raw")).filter(has_one(F.col("low"), every))
    raw, low, docs = F.col("raw"), F.col("low"), F.col("category") == "documentation"
    needs = lambda rule: has_one(low, NEEDS[rule.id])
    hits = []
    for n, rule in enumerate(SECRETS):
        severity: Column = F.lit(rule.severity)
        found = needs(rule) & raw.rlike(rule.pattern)
        if rule.id == "secret.connection-string":
            found = found & ~F.regexp_extract(raw, rule.pattern, 1).rlike(PLACEHOLDER)
            severity = F.when(F.regexp_extract(raw, rule.pattern, 2).rlike(LOCAL_HOST), "low").otherwise("medium")
        hits.append(F.array(F.when(found, hit(rule, severity, n))))
    values = F.filter(F.regexp_extract_all(raw, F.lit(ASSIGNMENT), F.lit(2)), lambda v: ~v.rlike(PLACEHOLDER) & (T.entropy(v) >= 3.0))
    hits.append(F.transform(F.when(~docs & needs(OTHERS[0]), values).otherwise(F.array().cast("array<string>")), lambda v, i: hit(OTHERS[0], F.lit("medium"), 50, i)))
    bare = F.regexp_replace(raw, POSSESSIVE, " ")
    for n, rule in enumerate(CODE, 100):
        hits.append(F.array(F.when(~docs & applies(rule, path, F.col("language")) & needs(rule) & (bare if rule.languages else raw).rlike(rule.pattern), hit(rule, F.lit(rule.severity), n))))
    hosts = F.regexp_extract_all(raw, F.lit(OTHERS[1].pattern), F.lit(1))
    plain = F.col("category").isin("source", "config") & raw.contains("http://") & F.exists(hosts, lambda h: ~h.rlike(SAFE_HOST))
    hits.append(F.array(F.when(plain, hit(OTHERS[1], F.lit("low"), 200))))
    # rules are tried in a lambda, not in one generated method too long to be compiled, and, by outer, not in a filter before
    tried = once(low, lambda _: F.array_compact(F.concat(*hits)))
    found = lines.select("repo_id", "path", "line", "in_test", "raw", F.explode_outer(tried).alias("h")).filter("h is not null").select("repo_id", "path", "line", "in_test", "raw", "h.*")
    images = unpinned_images(contents).select("repo_id", "path", "line", (P.is_test(path) | P.is_auxiliary(path)).alias("in_test"), F.concat(F.lit("FROM "), "image").alias("raw"), hit(OTHERS[2], F.lit("low"), 300).alias("h")).select("repo_id", "path", "line", "in_test", "raw", "h.*")
    return found.unionByName(images).withColumn("severity", downgraded(F.col("severity"), F.col("in_test")))


def scan(contents: DataFrame) -> DataFrame:
    """matches() as a report has them: of the first MAX_LINE characters of a line, at most PER_RULE a rule and file, the first
    ones."""
    return G.cap_per_group(matches(contents, C.MAX_LINE), ["repo_id", "path", "rule"], ["line", "emitted", "sub"], C.PER_RULE)


_SECRETS = [re.compile(r.pattern) for r in SECRETS]
_ASSIGNMENT = re.compile(ASSIGNMENT)


def redacted_line(line: str, width: int | None = 160) -> str:
    """A line as evidence: every match of every secret rule redacted, of width characters at most."""

    def stars(secret: str) -> str:
        return f"{secret[:4] if len(secret) > 8 else ''}********({len(secret)} chars)"

    out = line.strip()
    for pattern in _SECRETS:
        out = pattern.sub(lambda m: stars(m[0]), out)
    out = _ASSIGNMENT.sub(lambda m: m[0].replace(m[2], stars(m[2])), out)
    return out if width is None or len(out) <= width else out[: width - 3] + "..."


def with_evidence(findings: DataFrame, width: int | None = 160) -> DataFrame:
    """Evidence in place of the raw line, whole without width; what is replaced depends on the match, so Python does it, on findings alone."""

    @F.pandas_udf("string")
    def shown(raw):  # noqa: ANN001, ANN202
        return pd.Series([redacted_line(x, width) for x in raw], dtype="object")

    return findings.withColumn("evidence", shown("raw")).drop("raw")


def unpinned_images(contents: DataFrame) -> DataFrame:
    """repo_id, path, line, image of FROM lines without a version; stages named further up are no images."""
    from pyspark.sql import Window as W

    pattern = OTHERS[2].pattern
    own = P.name(F.col("path"))
    docker = contents.filter(P.starts_with_any(own, ("Dockerfile", "Containerfile")) | F.col("path").endswith(".dockerfile"))
    froms = source_lines(docker).filter(F.col("text").rlike(pattern)).select("repo_id", "path", "line", F.regexp_extract("text", pattern, 1).alias("image"), F.lower(F.regexp_extract("text", pattern, 2)).alias("alias"))
    before = W.partitionBy("repo_id", "path").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    stages = froms.withColumn("stages", F.collect_set(F.when(F.col("alias") != "", F.col("alias"))).over(before))
    last = F.element_at(F.split("image", "/"), -1)
    other = F.array_contains("stages", F.lower("image")) | (F.col("image") == "scratch") | F.col("image").rlike("[$@]")
    return stages.filter(~other & (~last.contains(":") | last.endswith(":latest"))).select("repo_id", "path", "line", "image")


def sensitive_files(tree: DataFrame, most_in_tests: int = 3) -> DataFrame:
    """repo_id, path, title, severity, in_test. Of each kind in tests the first few, and a row that counts the others."""
    path = F.col("path")
    kind = reduce(lambda acc, s: acc.when(path.rlike(s[0]), F.struct(F.lit(s[1]).alias("title"), F.lit(s[2]).alias("severity"))), SENSITIVE[1:], F.when(path.rlike(SENSITIVE[0][0]), F.struct(F.lit(SENSITIVE[0][1]).alias("title"), F.lit(SENSITIVE[0][2]).alias("severity"))))
    rows = analyzed_files(classified(tree)).withColumn("k", kind).filter("k is not null").select("repo_id", "ord", "path", "k.*", (P.is_test(path) | P.is_auxiliary(path)).alias("in_test"))
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy("repo_id", "title", "in_test").orderBy("ord"))
    placed = rows.withColumn("nth", nth)
    listed = placed.filter(~F.col("in_test") | (F.col("nth") <= most_in_tests)).select("repo_id", "path", "title", downgraded(F.col("severity"), F.col("in_test")).alias("severity"), "in_test")
    more = placed.filter(F.col("in_test") & (F.col("nth") > most_in_tests)).groupBy("repo_id", "title").agg(F.min_by("path", "nth").alias("path"), F.count(F.lit(1)).alias("n"))
    return listed.unionByName(more.select("repo_id", "path", F.concat("title", F.lit(" (+"), "n", F.lit(" more in test/example paths)")).alias("title"), F.lit("info").alias("severity"), F.lit(True).alias("in_test")))


def env_uses(contents: DataFrame) -> DataFrame:
    """repo_id, path, name of environment variables that the product's source and configuration read."""
    path = F.col("path")
    own = contents.filter(P.category(path).isin("source", "config") & ~P.is_test(path) & ~P.is_auxiliary(path))
    names = F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in ENV_USES]))
    return own.select("repo_id", "path", F.explode(F.array_distinct(names)).alias("name"))


def env_inventory(uses: DataFrame, most: int = 150) -> DataFrame:
    """uses(repo_id, path, name) rolled up: repo_id, variables (distinct names), files that read any, names (the first ones,
    sorted)."""
    counts = uses.groupBy("repo_id").agg(F.count_distinct("name").alias("variables"), F.count_distinct("path").alias("files"))
    names = G.cap_per_group(uses.select("repo_id", "name").distinct(), ["repo_id"], ["name"], most).groupBy("repo_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return counts.join(names, "repo_id")


def client_exposed(uses: DataFrame) -> DataFrame:
    name = F.col("name")
    return uses.filter(P.starts_with_any(name, PUBLIC) & name.rlike(SECRET_NAME) & ~name.rlike(PUBLIC_OK)).select("repo_id", "name").distinct()


def gitignore(tree: DataFrame, contents: DataFrame) -> DataFrame:
    """repo_id, present, and whether .env files are excluded (null if the file wasn't downloaded)."""
    present = tree.groupBy("repo_id").agg(F.bool_or((F.col("type") == "file") & (F.col("path") == ".gitignore")).alias("present"))
    line = T.strip(F.col("text"))
    forms = line.rlike(r"^/?(\*\*/)?\.env(\*|\.\*|\.local|\*\.local)?$") | line.isin("*.env", ".env*", "**/.env", ".env.*")
    lines = source_lines(contents.filter("path = '.gitignore'")).groupBy("repo_id").agg(F.bool_or(forms & ~line.startswith("#")).alias("env_excluded"))
    read = contents.filter("path = '.gitignore'").select("repo_id", F.lit(False).alias("read")).distinct()
    return present.join(read, "repo_id", "left").join(lines, "repo_id", "left").select("repo_id", "present", F.coalesce("env_excluded", "read").alias("env_excluded"))


def findings(tree: DataFrame, contents: DataFrame) -> DataFrame:
    """All findings of each repository, by severity, category, path and line, the first MAX_FINDINGS."""
    scanned = with_evidence(scan(contents)).select("repo_id", "rule", "severity", "confidence", "category", "path", "line", "evidence", "in_test", F.lit(1).alias("source"), "emitted")
    shape = lambda df, rule, severity, path, evidence, in_test, n: df.select("repo_id", F.lit(rule.id).alias("rule"), severity.alias("severity"), F.lit(rule.confidence).alias("confidence"), F.lit(rule.category).alias("category"), path.alias("path"), F.lit(None).cast("int").alias("line"), evidence.alias("evidence"), in_test.alias("in_test"), F.lit(n).alias("source"), F.lit(0).alias("emitted"))
    files = shape(sensitive_files(tree), OTHERS[3], F.col("severity"), F.col("path"), F.col("title"), F.col("in_test"), 0)
    uses = env_uses(contents)
    exposed = shape(client_exposed(uses), OTHERS[4], F.lit("medium"), F.lit("(multiple files)"), F.col("name"), F.lit(False), 2)
    state = gitignore(tree, contents).join(uses.select("repo_id").distinct(), "repo_id", "left_semi")
    missing = shape(state.filter("not present"), Rule("gitignore.missing", "low", "gitignore", "medium", ""), F.lit("low"), F.lit(".gitignore"), F.lit(None).cast("string"), F.lit(False), 3)
    open_ = shape(state.filter("present and not env_excluded"), OTHERS[5], F.lit("low"), F.lit(".gitignore"), F.lit(None).cast("string"), F.lit(False), 3)
    every = reduce(DataFrame.unionByName, [files, scanned, exposed, missing, open_])
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return G.cap_per_group(every, ["repo_id"], [rank, "category", "path", F.coalesce("line", F.lit(0)), "source", "emitted"], C.MAX_FINDINGS)


def by_severity(found: DataFrame) -> DataFrame:
    wide = found.groupBy("repo_id").pivot("severity", list(SEVERITIES)).agg(F.count(F.lit(1)))
    return wide.select("repo_id", *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in SEVERITIES])


def rules(spark) -> DataFrame:  # noqa: ANN001
    """The catalogue."""
    return spark.createDataFrame([(r.id, r.severity, r.category, r.confidence) for r in SECRETS + CODE + OTHERS], "id string, severity string, category string, confidence string")
