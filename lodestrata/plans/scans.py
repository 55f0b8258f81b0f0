"""The rules over whole texts of documents. A document is a file of its source; to its text a line is added, of one of the
kinds that rules look for, with secrets made of the key's hash. The SQL tries every rule on every line of what results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import security
from .queries import query, table

# Expressions that Spark and DuckDB read alike.
HASH = "md5(CAST(doc_id AS STRING))"
PATH = """CASE doc_id % 9 WHEN 3 THEN 'web/d' || CAST(doc_id AS STRING) || '.ts' WHEN 4 THEN 'tests/d' || CAST(doc_id AS STRING) || '.py' WHEN 5 THEN '.github/workflows/d' || CAST(doc_id AS STRING) || '.yml'
WHEN 6 THEN 'app/' || CAST(doc_id AS STRING) || '/settings.py' WHEN 7 THEN 'old/d' || CAST(doc_id AS STRING) || '.php' WHEN 8 THEN 'docs/d' || CAST(doc_id AS STRING) || '.md' ELSE 'src/d' || CAST(doc_id AS STRING) || '.py' END"""
ADDED = [
    "'-----BEGIN RSA PRIVATE KEY-----'", f"'k = AKIA' || upper(substr({HASH}, 1, 16))", f"'k = ghp_' || {HASH} || substr({HASH}, 1, 4)", f"'xoxb-' || {HASH}", f"'a sk_live_' || {HASH} || ' b'",
    f"'AIza' || {HASH} || substr({HASH}, 1, 3)", f"'sk-ant-' || {HASH}", f"'npm_' || {HASH} || substr({HASH}, 1, 4)", f"'SG.' || substr({HASH}, 1, 22) || '.' || {HASH} || substr({HASH}, 1, 11)",
    f"'postgres://u:' || CASE WHEN doc_id % 5 = 0 THEN 'changeme12' ELSE substr({HASH}, 1, 10) END || '@' || CASE WHEN doc_id % 3 = 0 THEN 'localhost' ELSE 'db.corp.com' END || '/x'",
    f"""'  client_secret = "' || CASE WHEN doc_id % 4 = 0 THEN 'aaaaaaaabb' ELSE {HASH} END || '"'""", "'x = eval(y)'", """'subprocess.run("a", shell=True)'""", """'os.system("ls")'""", "'pickle.loads(b)'",
    "CASE WHEN doc_id % 2 = 0 THEN 'yaml.load(f)' ELSE 'yaml.load(f, Loader=yaml.SafeLoader)' END", "'get(u, verify=False)'", "'el.innerHTML = x'", """'require("child_process").execSync("ls")'""", "'shell_exec(c)'",
    """'allow_origins=["*"]'""", "'DEBUG = True'", "'curl https://get.corp.com/i.sh | sudo bash'", "'on: pull_request_target'", "'run: echo ${{ github.event.issue.title }}'",
    "CASE WHEN doc_id % 2 = 0 THEN 'uses: corp/act@v1' ELSE 'uses: actions/checkout@v4' END", "'permissions: write-all'", """'u = "http://' || CASE WHEN doc_id % 2 = 0 THEN 'api.corp.com' ELSE 'localhost' END || '/x"'""", """'# eval(y) "eval(z)"'""",
]
LINE = f"CASE doc_id % {len(ADDED)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(ADDED)) + " END"


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("source").alias("repo_id"), F.expr(PATH).alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.expr(LINE), F.lit("\n")).alias("text"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: Patterns that look around, said without that.
PLAIN = {
    "code.python-eval": r"(?:^|[^\w.])(?:eval|exec)\s*\(", "code.js-eval": r"(?:^|[^\w.$])eval\s*\(|\bnew\s+Function\s*\(", "code.js-inner-html": r"dangerouslySetInnerHTML|\.(?:inner|outer)HTML\s*=(?:[^=]|$)|v-html\s*=",
    "code.php-dangerous": r"(?:^|[^\w>$])(?:eval|unserialize|shell_exec|passthru|system|exec)\s*\(", "code.python-yaml-load": r"\byaml\.load\s*\(", "ci.pull-request-target": r"^.*\bpull_request_target\b",
    "ci.unpinned-action": r"uses:\s*[\w.-]+/[\w./-]+@\S+",
}
#: What a line must not match then.
BUT = {"code.python-yaml-load": r"yaml\.load\s*\([^)]*(?:SafeLoader|safe_load)", "ci.pull-request-target": r"^\s*#", "ci.unpinned-action": r"uses:\s*(?:actions/|github/)|@[0-9a-f]{40}\b"}
LANGUAGES = {"py": "Python", "ts": "TypeScript", "php": "PHP", "yml": "YAML", "md": "Markdown"}


def _matches(rule: security.Rule) -> str:
    line = "bare" if rule.languages else "raw"
    test = f"regexp_matches({line}, {_quoted(PLAIN.get(rule.id, rule.pattern))})"
    if rule.id in BUT:
        test += f" AND NOT regexp_matches({line}, {_quoted(BUT[rule.id])})"
    if rule.languages:
        test += " AND language IN (" + ", ".join(map(_quoted, rule.languages)) + ")"
    if rule.files:
        test += " AND (" + " OR ".join(f"starts_with({'path' if f.endswith('/') else 'name'}, {_quoted(f)})" for f in rule.files) + ")"
    if rule in security.CODE:
        test += " AND NOT docs"
    if rule.id == "secret.connection-string":
        test += f" AND NOT regexp_matches(regexp_extract(raw, {_quoted(rule.pattern)}, 1), {_quoted(security.PLACEHOLDER)})"
    return test


def _rows() -> str:
    out = []
    for rule in security.SECRETS + security.CODE:
        severity = _quoted(rule.severity)
        if rule.id == "secret.connection-string":
            severity = f"CASE WHEN regexp_matches(regexp_extract(raw, {_quoted(rule.pattern)}, 2), {_quoted(security.LOCAL_HOST)}) THEN 'low' ELSE 'medium' END"
        out.append(f"SELECT *, {_quoted(rule.id)} AS rule, {severity} AS base, {_quoted(rule.confidence)} AS confidence, {_quoted(rule.category)} AS about FROM l WHERE {_matches(rule)}")
    value = f"regexp_extract(raw, {_quoted(security.ASSIGNMENT)}, 2)"
    out.append(f"SELECT *, 'secret.generic-assignment', 'medium', 'low', 'secret' FROM l WHERE NOT docs AND {value} <> '' AND NOT regexp_matches({value}, {_quoted(security.PLACEHOLDER)}) AND list_entropy(string_split({value}, '')) >= 3.0")
    host = f"regexp_extract(raw, {_quoted(security.OTHERS[1].pattern)}, 1)"
    out.append(f"SELECT *, 'transport.insecure-http', 'low', 'medium', 'insecure-transport' FROM l WHERE NOT docs AND NOT starts_with(path, 'tests/') AND {host} <> '' AND NOT regexp_matches({host}, {_quoted(security.SAFE_HOST)})")
    return "\nUNION ALL ".join(out)


SECRET = "(" + "|".join(rule.pattern for rule in security.SECRETS) + ")"
FOUND = rf"""WITH t AS (SELECT source AS repo_id, {PATH} AS path, coalesce(text, '') || chr(10) || {LINE} AS text FROM documents),
s AS (SELECT repo_id, path, regexp_split_to_array(text, '{T.LINE_BREAK}') AS x FROM t),
l AS (SELECT repo_id, path, CAST(i AS INTEGER) AS line, raw, regexp_replace(raw, {_quoted(security.LITERAL)}, ' ', 'g') AS bare, regexp_extract(path, '[^/]*$') AS name, ends_with(path, '.md') AS docs, starts_with(path, 'tests/') OR starts_with(path, 'docs/') AS in_test,
 CASE regexp_extract(path, '[a-z]+$') {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items())} END AS language FROM (SELECT repo_id, path, unnest(x) AS raw, unnest(range(1, len(x) + 1)) AS i FROM s)),
h AS ({_rows()}),
e AS (SELECT *, regexp_extract(raw, {_quoted(SECRET)}) AS secret, regexp_extract(raw, {_quoted(security.ASSIGNMENT)}, 2) AS value FROM h),
f AS (SELECT repo_id, path, line, rule, CASE WHEN NOT in_test THEN base WHEN base = 'high' THEN 'medium' WHEN base = 'medium' THEN 'low' ELSE 'info' END AS severity, confidence, about AS category, in_test,
 trim(CASE WHEN secret <> '' THEN replace(raw, secret, left(secret, 4) || '********(' || length(secret) || ' chars)') WHEN value <> '' THEN replace(raw, value, left(value, 4) || '********(' || length(value) || ' chars)') ELSE raw END) AS evidence FROM e) """


@query(FOUND + "SELECT * FROM f")
def v16_document_findings(spark, sf):
    return security.with_evidence(security.matches(texts(spark, sf)).drop("emitted", "sub"), None)


@query(FOUND + "SELECT rule, severity, count(*) AS findings, count(DISTINCT path) AS files FROM f GROUP BY 1, 2")
def u08_rule_findings(spark, sf):
    """Of each rule and severity."""
    return security.matches(texts(spark, sf)).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("path").alias("files"))
