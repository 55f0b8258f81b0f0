"""Each rule of lines, and the literals that are looked for before a pattern is tried."""

import re

from lodestrata.operators import security
from tests.test_analyses import contents_of

HEX = "0123456789abcdef" * 2
# A line of each rule, and lines that look like it but aren't; files are chosen by the rule's scope.
LINES = {
    "secret.private-key": (["-----BEGIN PRIVATE KEY-----", "-----BEGIN PGP PRIVATE KEY BLOCK-----"], ["-----BEGIN PUBLIC KEY-----"]),
    "secret.aws-access-key": (["AKIA" + "A1" * 8, "asia: ASIA" + "0" * 16], ["AKIA" + "a" * 16, "xAKIA" + "A" * 16]),
    "secret.github-token": (["ghs_" + HEX + "abcd", "github_pat_" + HEX * 2], ["ghx_" + HEX + "abcd"]),
    "secret.slack-token": (["xoxp-" + HEX], ["xoxz-" + HEX]),
    "secret.stripe-live-key": (["sk_live_" + HEX, "rk_live_" + HEX], ["sk_test_" + HEX]),
    "secret.google-api-key": (["AIza" + HEX + "-_a"], ["AIza" + HEX]),
    "secret.llm-api-key": (["sk-proj-" + HEX, "sk-" + "a" * 20 + "T3BlbkFJ" + "b" * 20], ["sk-" + HEX]),
    "secret.npm-token": (["npm_" + HEX + "abcd"], ["npm_" + HEX]),
    "secret.sendgrid-key": (["SG." + "a" * 22 + "." + "b" * 43], ["SG." + "a" * 22]),
    "secret.connection-string": (["redis://u:s3cr3t@h.io/0"], ["redis://u:${PW}@h.io/0", "redis://h.io/0"]),
    "secret.generic-assignment": (['db_PASSWORD: "q8W!zR2xT"', "apiKey = 'q8WzR2xTv'"], ['password = "aaaaaaaa"', 'password = "your_secret1"', "monkey = 'q8WzR2xTv'"]),
    "code.python-eval": (["x = exec (y)"], ["model.eval(y)", "# eval(y)", "retrieval(y)"]),
    "code.python-shell-true": (["subprocess.call(c, shell = True)"], ["subprocess.call(c)"]),
    "code.python-os-system": (["os.system(c)"], ["# os.system(c)"]),
    "code.python-pickle": (["dill.load(f)", "cPickle.loads(f)"], ["pickle.dump(f)"]),
    "code.python-yaml-load": (["yaml.load(f)"], ["yaml.load(f, SafeLoader)", "yaml.safe_load(f)"]),
    "code.tls-verify-disabled": (["InsecureSkipVerify: true", "NODE_TLS_REJECT_UNAUTHORIZED = '0'", "VERIFY=false"], ["verify=True"]),
    "code.js-eval": (["new Function(a)", "eval(a)"], ["x.eval(a)"]),
    "code.js-inner-html": (["a.outerHTML = b", '<p v-html="c">', "dangerouslySetInnerHTML"], ["a.innerHTML == b"]),
    "code.js-child-process": (["execSync(c)", "child_process.exec(c)"], ["a.exec(c)"]),
    "code.php-dangerous": (["passthru($x);"], ["$o->exec($x);"]),
    "code.cors-wildcard": (["allow_origins = ['*']", "origin: '*'", "Access-Control-Allow-Origin: '*'"], ["origin: 'a'"]),
    "config.debug-enabled": (["DEBUG = True"], ["DEBUG = False", "X_DEBUG = True"]),
    "docker.curl-pipe-shell": (["wget -O- u | sh"], ["curl u > f"]),
    "ci.pull-request-target": (["  pull_request_target:"], ["# pull_request_target"]),
    "ci.script-injection": (["echo ${{ github.event.pull_request.title }}"], ["echo ${{ github.event.number }}"]),
    "ci.unpinned-action": (["uses: a/b@v1"], ["uses: actions/x@v1", "uses: a/b@" + HEX + "abcdefab"]),
    "ci.write-all-permissions": (["permissions: write-all"], ["permissions: read-all"]),
    "transport.insecure-http": (["u = http://a.b.com/x"], ["u = http://localhost/x", "u = http://10.1.2.3/", "u = http://www.w3.org/1999"]),
}


def file_for(rule):
    endings = {"Python": "py", "JavaScript": "js", "PHP": "php"}
    if rule.files:
        return ".github/workflows/{}.yml" if rule.files == security.CI else "{}/settings.py"
    return "src/{}." + (endings[rule.languages[0]] if rule.languages else "go")


def test_every_rule(spark):
    every = [r for r in security.SECRETS + security.CODE + security.OTHERS[:2]]
    assert {r.id for r in every} == set(LINES) == set(security.NEEDS)
    files, wanted = {}, set()
    for rule in every:
        for good, lines in zip((True, False), LINES[rule.id]):
            for i, line in enumerate(lines):
                path = file_for(rule).format(f"{rule.id.replace('.', '-')}-{good}-{i}")
                files[path] = f"plain\n{line}\n"
                wanted |= {(path, 2, rule.id)} if good else set()
    got = {(r.path, r.line, r.rule) for r in security.scan(contents_of(spark, files)).collect()}
    assert wanted <= got
    assert not [x for x in got if x[2].replace(".", "-") + "-False" in x[0]]


def test_literals_are_needed():
    """What a pattern matches holds one of the rule's literals, and so one of those that all rules share."""
    for rule, (good, _) in LINES.items():
        for line in good:
            assert any(x in line.lower() for x in security.NEEDS[rule]) and any(x in line.lower() for x in security.literals())


def test_severities(spark):
    files = {"src/a.go": "redis://u:s3cr3t@localhost/0\n", "src/b.go": "redis://u:s3cr3t@h.io/0\n", "tests/c.go": "redis://u:s3cr3t@h.io/0\n", "tests/d.go": "-----BEGIN PRIVATE KEY-----\n", "docs/e.md": "eval(x)\npassword = 'q8WzR2xTv'\nxoxb-0123456789ab\n", "none.go": "nothing\n", "empty.go": "", "null.go": None}
    got = {(r.path, r.rule, r.severity) for r in security.scan(contents_of(spark, files)).collect()}
    line = "secret.connection-string"
    assert got == {("src/a.go", line, "low"), ("src/b.go", line, "medium"), ("tests/c.go", line, "low"), ("tests/d.go", "secret.private-key", "medium"), ("docs/e.md", "secret.slack-token", "medium")}


def test_evidence_holds_no_secret():
    for rule in [r.id for r in security.SECRETS] + ["secret.generic-assignment"]:
        for line in LINES[rule][0]:
            shown = security.redacted_line(line)
            assert "********(" in shown and not any(len(x) > 12 and x in line for x in re.findall(r"[A-Za-z0-9]+", shown) if x not in ("chars", "PASSWORD"))


def test_texts_are_split_and_rules_tried_once(spark):
    contents = spark.createDataFrame([("r", "a.py", "x = eval(y)\n")], "repo_id string, path string, text string").localCheckpoint()
    plan = security.scan(contents)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("split(text" in line or "AKIA" in line for line in filters)
