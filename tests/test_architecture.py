from lodestrata.operators import architecture, dependencies, workspaces
from tests.test_analyses import contents_of, rows, tree_of


def test_frameworks_tooling_and_entry_points(spark):
    files = {
        "package.json": '{"dependencies": {"Next": "1", "react": "2"}, "devDependencies": {"express": "1", "vite": "1", "jest": "1"}, "main": "lib/index.js", "bin": {"x": "./cli.js"}}',
        "pyproject.toml": "[tool.ruff]\n[project]\nname='p'\n[project.scripts]\nrun = 'p:main'\n",
        "manage.py": "if __name__ == '__main__':\n    pass\n",
        ".github/workflows/ci.yml": "run: black --check\n",
        "Dockerfile": "FROM a\nCMD run me\n",
        "examples/app.py": "",
        "go.mod": "module m\nrequire github.com/labstack/echo/v4 v4.0.0\n",
    }
    tree, contents = tree_of(spark, files), contents_of(spark, files)
    deps = dependencies.analyze(tree, contents).dependencies
    assert rows(architecture.frameworks(tree, deps), "framework", "category") == [("Django", "backend"), ("Echo", "backend"), ("Next.js", "frontend"), ("React", "frontend"), ("Vite", "build")]
    assert {r.label for r in architecture.project_types(architecture.frameworks(tree, deps)).collect()} == {"Web frontend", "Web / API service"}
    assert rows(architecture.tooling(tree, contents, deps), "kind", "tool") == [("ci", "GitHub Actions"), ("formatters", "Black"), ("linters", "Ruff"), ("test_frameworks", "Jest")]
    assert {(r.path, r.kind) for r in architecture.entry_points(tree, contents).collect()} == {("manage.py", "Django management"), ("lib/index.js", "Package entry"), ("cli.js", "CLI command"), ("p:main", "CLI command"), ("Dockerfile:CMD", "Container command")}


def test_monorepo_and_modules(spark):
    files = {"pnpm-workspace.yaml": "packages:\n  - 'packages/*'\n  - '!packages/old'\n", "packages/a/package.json": "{}", "packages/b/package.json": "{}", "packages/old/package.json": "{}", "packages/a/src/x.ts": "", "packages/a/lib/z.ts": "", "packages/b/y.ts": "", "docs/i.md": "", "top.ts": ""}
    tree = tree_of(spark, files)
    found = workspaces.monorepos(tree, contents_of(spark, files))
    assert [tuple(r) for r in found.collect()] == [("r", "pnpm workspaces", ["packages/a", "packages/b"])]
    got = {r.module: (r.files, r.role) for r in architecture.modules(tree, found.select("repo_id", "packages")).collect()}
    assert got["packages/a/src"] == (1, None) and got["docs"] == (1, "Documentation / examples") and got["."] == (2, None) and got["packages/b"] == (2, None)


def test_globs(spark):
    globs = ["packages/*", "apps/**", "./l?b/", "!packages/old", "x.y/a*/**/z", "tools"]
    paths = {"packages/a": True, "packages/a/b": False, "packages/old": False, "packages": False, "apps": True, "apps/x/y": True, "apps2": False, "lib": True, "lb": False, "x.y/ab/q/z": True, "xzy/ab/q/z": False, "x.y/ab/q/r/z": True, "tools": True, "tools/x": False}
    frame = lambda rows, name: spark.createDataFrame([("r", x) for x in rows] + [("other", x) for x in rows if name == "path"], f"repo_id string, {name} string")
    assert sorted((r.repo_id, r.path) for r in workspaces.matched(frame(paths, "path"), frame(globs, "glob")).collect()) == sorted(("r", p) for p, yes in paths.items() if yes)


def test_declared_globs(spark):
    files = {
        "pnpm-workspace.yaml": "name: x\npackages:\n  - 'a/*'  # note\n\n  - \"!b\"\n  - c\nother:\n  - no\n", "package.json": '{"workspaces": {"packages": ["d/*", "e"]}}', "lerna.json": '{"packages": ["f"]}',
        "Cargo.toml": "[workspace]\nmembers = [\n 'g/*', # g\n 'h']\n", "go.work": "go 1.2\nuse (\n  ./i\n  ./j/k\n)\nuse ./l\n", "sub/package.json": '{"workspaces": ["no"]}',
    }
    found = [r.glob for r in workspaces.declared(contents_of(spark, files)).collect()]
    assert sorted(found) == sorted(["a/*", "!b", "c", "d/*", "e", "f", "g/*", "h", "i", "j/k", "l"])
    broken = {"package.json": '{"workspaces": 3', "lerna.json": "[]", "Cargo.toml": "[workspace", "pnpm-workspace.yaml": ""}
    assert workspaces.declared(contents_of(spark, broken)).count() == 0


def test_infrastructure(spark):
    files = {"Dockerfile": "FROM a", "compose.yml": "services:\n  web:\n    image: 'x:1'\n    depends_on:\n      - db\n  db:\n    build: .\n    depends_on: [a, b]\nvolumes:\n  v:\n", "k.yaml": "kind: Service\n", "t/a.tf": 'provider "aws" {}', "t/b.tf": 'provider "gcp" {}\nprovider "aws" {}', "Procfile": ""}
    contents = contents_of(spark, files)
    assert rows(architecture.infrastructure(tree_of(spark, files), contents), "kind", "path", "detail") == [("Container image", "Dockerfile", "Dockerfile"), ("Deployment config", "Procfile", "Procfile"), ("Docker Compose", "compose.yml", "2 service(s)"), ("Kubernetes manifest", "k.yaml", "kind: Service"), ("Terraform", "t", "2 .tf file(s); providers: aws, gcp")]
    assert rows(architecture.compose_services(contents), "name", "image", "build", "depends_on") == [("db", None, True, ["a", "b"]), ("web", "x:1", False, ["db"])]
