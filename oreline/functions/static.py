"""Fixed values of ruleset 1.0.0: registries, orders, weights and the rule table.

Names, patterns and thresholds below are fixed values that results depend on.
"""

from __future__ import annotations

RULESET_VERSION = "1.0.0"

# File extensions.
JAVASCRIPT = (".js", ".jsx", ".mjs", ".cjs")
TYPESCRIPT = (".ts", ".tsx", ".mts", ".cts")
DEEP = (*JAVASCRIPT, *TYPESCRIPT, ".py")
RECOGNIZED = (*DEEP, *".go .rs .c .h .cc .cpp .cxx .hpp .java .kt .kts .cs .fs .fsx .rb .php .swift .dart .scala .sc .sh .bash .zsh .fish .lua .r .ex .exs .erl .hrl .clj .cljs .hs .lhs .vue .svelte .astro".split())
DOCUMENTS = (".md", ".mdx", ".markdown", ".txt", ".rst", ".adoc", ".asciidoc")
BINARIES = tuple(".7z .a .apk .avi .bin .bmp .bz2 .class .db .dll .dmg .doc .docx .dylib .eot .exe .gif .gz .ico .jar .jpeg .jpg .lockb .mov .mp3 .mp4 .o .obj .otf .pdf .png .pyc .rar .so .sqlite .sqlite3 .svgz .tar .tgz .ttf .wav .webm .webp .woff .woff2 .xls .xlsx .xz .zip".split())

# Path segments.
VERSION_CONTROL = (".git", ".hg", ".svn")
GENERATED = tuple("node_modules vendor third_party dist build out coverage .coverage .cache .next .nuxt target bin obj __pycache__ .venv venv".split())
EXCLUDED = (*VERSION_CONTROL, *GENERATED)
TEST_SEGMENTS = ("test", "tests", "__tests__", "spec", "specs")
WRAPPERS = ("src", "source", "lib", "app", "apps", "pkg", "packages", *TEST_SEGMENTS)

# Base names, in lower case.
MANIFESTS = tuple("package.json pyproject.toml setup.py setup.cfg requirements.txt pipfile cargo.toml go.mod pom.xml build.gradle build.gradle.kts composer.json gemfile package.swift pubspec.yaml cmakelists.txt makefile taskfile.yml taskfile.yaml justfile".split())
LOCKFILES = tuple("pnpm-lock.yaml package-lock.json npm-shrinkwrap.json yarn.lock bun.lock bun.lockb uv.lock poetry.lock pipfile.lock cargo.lock go.sum composer.lock gemfile.lock package.resolved".split())
CI_PATHS = (".gitlab-ci.yml", ".circleci/config.yml", "azure-pipelines.yml", "jenkinsfile", ".travis.yml", "bitbucket-pipelines.yml", "appveyor.yml")
DEPENDENCY_UPDATES = (".github/dependabot.yml", ".github/dependabot.yaml", "renovate.json", "renovate.json5", ".renovaterc", ".renovaterc.json", ".renovaterc.json5")
TEMPLATE_FOLDERS = (".github/issue_template/", ".github/pull_request_template/")
TEMPLATE_FILE = ".github/pull_request_template.md"
COVERAGE_NAMES = (".coveragerc", "coverage.xml", "codecov.yml", "codecov.yaml", ".codecov.yml", ".codecov.yaml")
COVERAGE_PREFIXES = ("jest.config.", "vitest.config.", "nyc.config.")
ENVIRONMENT_EXAMPLES = (".env.example", ".env.sample")
CONFIG_EXAMPLE = r"^(?:config\.(?:example|sample)|(?:example|sample)\.config)\."
TOOL_CONFIG = r"^(?:eslint|prettier|babel|rollup|webpack|vite|vitest|jest|karma|ava)\.config\."
TS_CONFIG = r"^(?:tsconfig|jsconfig)(?:\.[^.]+)*\.json$"
COMPOSE = r"^(?:docker-compose|compose)(?:\.[^.]+)?\.ya?ml$"
TOOL_FILES = ("pytest.ini", "tox.ini", "noxfile.py", "mypy.ini", ".flake8", "ruff.toml", ".ruff.toml", "pyrightconfig.json", "dockerfile", "procfile", "vercel.json", "netlify.toml")

# Priority documents (scopes, stems, whole stem or beginning).
ROOT, GITHUB, DOCS = "", ".github", "docs"
PRIORITY_DOCUMENTS = {
    "readme": ((ROOT, GITHUB), ("readme",), False),
    "license": ((ROOT,), ("license", "licence", "copying"), False),
    "contribution": ((ROOT, GITHUB, DOCS), ("contributing",), False),
    "security": ((ROOT, GITHUB, DOCS), ("security",), True),
    "code_of_conduct": ((ROOT, GITHUB, DOCS), ("code_of_conduct",), False),
    "version_history": ((ROOT, DOCS), ("changelog", "changes", "history", "releases"), False),
    "architecture": ((ROOT, DOCS), ("architecture",), False),
    "setup": ((ROOT, DOCS), ("install", "installation", "setup", "getting_started", "quickstart"), False),
}
ENTRY_STEMS = ("index", "main", "app", "server", "cli")
EXECUTABLES = tuple("npm npx pnpm yarn bun node deno python python3 pip pip3 uv poetry pytest tox make just task go cargo mvn gradle gradlew dotnet swift docker docker-compose".split())
HEADINGS = {
    "installation": ("install", "installation", "setup", "getting started", "quick start", "prerequisites", "安装", "配置环境", "环境要求", "准备工作", "快速开始"),
    "usage": ("usage", "use", "run", "running", "example", "examples", "quick start", "使用", "用法", "运行", "示例", "快速开始"),
    "architecture": ("architecture", "structure", "project layout", "repository layout", "codebase", "code map", "架构", "结构", "项目结构", "目录结构", "代码结构", "代码地图"),
    "configuration": ("configuration", "config", "environment variables", "settings", "配置", "环境变量", "设置"),
}

# Limits.
MAX_FILE_BYTES = 256 * 1024
MAX_FILES = 200
MAX_BYTES = 10 * 1024 * 1024
CACHE_TTL_MS = 900_000
CACHE_BYTES = 2 * 1024 * 1024
CLONE_WINDOW = 50
SAFE_INTEGER = 2**53 - 1

# Dimensions and their weights, in report order.
WEIGHTS = {"documentation": 15, "operability": 20, "readability": 20, "complexity": 20, "testing": 15, "maintenance": 10}

_RATIO = "least(1.0, {0} / cast({1} as double))"


def _flag(rule: str, points: int, column: str) -> tuple:
    return rule, points, column, "false", 0, "true", "true"


def _pair(rule: str, points: int, passed: str, partial: str, worth: int) -> tuple:
    return rule, points, passed, partial, worth, "true", "true"


def _count(a: str, b: str) -> str:
    return f"{a} >= 0 and {b} > 0 and {a} <= {b}"


# Rule, points, passed, partial, partial points, applicable, valid. Conditions are plain SQL over metric columns.
RULES: tuple[tuple, ...] = (
    _flag("documentation.readme", 3, "has_readme"),
    _pair("documentation.installation", 3, "install_heading and install_command", "install_heading", 1),
    _pair("documentation.usage", 3, "usage_heading and usage_concrete", "usage_heading", 1),
    _flag("documentation.contributing", 2, "has_contributing"),
    _pair("documentation.license", 2, "has_license_file", "license_metadata", 1),
    ("documentation.architecture", 2, "architecture_explicit", "area_count >= 3", 1, "true", "area_count >= 0"),
    _flag("operability.manifest", 4, "has_manifest"),
    _pair("operability.entry-point", 4, "entry_structured", "entry_conventional", 2),
    _pair("operability.run-build", 4, "run_command and build_command", "run_command or build_command", 2),
    _pair("operability.example", 3, "example_concrete", "example_prose", 1),
    ("operability.error-handling", 2, f"{_RATIO.format('handled', 'functions')} >= 0.05", "handled > 0", 1, "functions_applicable", _count("handled", "functions")),
    _pair("operability.version-history", 2, "version_history", "manifest_version", 1),
    _flag("operability.configuration", 1, "has_configuration"),
    ("readability.median-function-length", 4, "length_median <= 40", "length_median <= 60", 2, "functions_applicable", "lengths_valid and length_median >= 0"),
    ("readability.p90-function-length", 4, "length_p90 <= 80", "length_p90 <= 120", 2, "functions_applicable", "lengths_valid and length_p90 >= 0"),
    ("readability.large-file-ratio", 4, f"{_RATIO.format('over_500', 'source_files')} <= 0.1", f"{_RATIO.format('over_500', 'source_files')} <= 0.2", 2, "deep_applicable", f"lines_valid and {_count('over_500', 'source_files')}"),
    ("readability.median-nesting", 3, "nesting_median <= 3", "nesting_median = 4", 1, "functions_applicable", "nesting_valid and nesting_median >= 0"),
    ("readability.ambiguous-identifiers", 3, f"{_RATIO.format('ambiguous', 'identifiers')} <= 0.1", f"{_RATIO.format('ambiguous', 'identifiers')} <= 0.2", 1, "deep_applicable and (identifiers > 0 or not identifiers_valid)", f"identifiers_valid and {_count('ambiguous', 'identifiers')}"),
    ("readability.documented-exports", 2, f"{_RATIO.format('documented', 'exported')} >= 0.2", f"{_RATIO.format('documented', 'exported')} >= 0.1", 1, "deep_applicable and (exported > 0 or not exports_valid)", f"exports_valid and {_count('documented', 'exported')}"),
    ("complexity.median-cyclomatic", 4, "cyclomatic_median <= 5", "cyclomatic_median <= 8", 2, "functions_applicable", "cyclomatic_valid and cyclomatic_median >= 1"),
    ("complexity.p90-cyclomatic", 5, "cyclomatic_p90 <= 15", "cyclomatic_p90 <= 25", 2, "functions_applicable", "cyclomatic_valid and cyclomatic_p90 >= 1"),
    ("complexity.max-nesting", 3, "nesting_max <= 5", "nesting_max <= 7", 1, "functions_applicable", "nesting_valid and nesting_max >= 0"),
    ("complexity.very-large-files", 3, "over_1000 = 0", f"{_RATIO.format('over_1000', 'source_files')} <= 0.02", 1, "deep_applicable", f"lines_valid and {_count('over_1000', 'source_files')}"),
    ("complexity.duplication", 3, "duplicate_ratio <= 0.05", "duplicate_ratio <= 0.1", 1, "deep_applicable and (duplicate_total > 0 or not duplicates_valid)", f"duplicates_valid and duplicate_ratio >= 0 and duplicate_ratio <= 1 and {_count('duplicate_tokens', 'duplicate_total')} and abs(duplicate_ratio - duplicate_tokens / cast(duplicate_total as double)) <= 8.881784197001252e-16"),
    ("complexity.circular-imports", 2, "cycle_components = 0", "cycle_components = 1 and cycle_largest = 2", 1, "deep_applicable", "cycles_valid and cycle_components >= 0 and cycle_largest >= 0 and (case when cycle_components = 0 then cycle_largest = 0 else cycle_largest >= 2 end)"),
    ("testing.test-files", 4, "test_files > 0", "test_configuration", 1, "true", "test_files >= 0"),
    ("testing.test-source-ratio", 3, f"{_RATIO.format('test_files', 'source_count')} >= 0.25", f"{_RATIO.format('test_files', 'source_count')} >= 0.1", 1, "source_count <> 0", "test_files >= 0 and source_count > 0"),
    _flag("testing.ci", 3, "has_ci"),
    _pair("testing.test-command", 2, "test_structured", "test_documented", 1),
    _pair("testing.static-check", 2, "check_structured", "check_documented", 1),
    _flag("testing.coverage", 1, "has_coverage"),
    ("maintenance.activity", 2, "not archived and elapsed_days <= 180", "not archived and elapsed_days <= 365", 1, "true", "elapsed_days >= 0"),
    _flag("maintenance.lockfile", 2, "has_lockfile"),
    _flag("maintenance.dependency-updates", 1, "has_dependency_updates"),
    _flag("maintenance.templates", 1, "has_templates"),
    _flag("maintenance.security", 1, "has_security"),
    _flag("maintenance.code-of-conduct", 1, "has_code_of_conduct"),
    _flag("maintenance.version-history", 1, "version_history"),
    ("maintenance.generated-directories", 1, "generated_count = 0", "generated_count = 1", 0, "true", "generated_count >= 0"),
)
RULE_IDS = tuple(r[0] for r in RULES)


def english_rank() -> dict[str, int]:
    """Place of each rule id where punctuation comes before letters and '-' before '.'."""
    order = sorted(RULE_IDS, key=lambda i: [" -.".find(c) if c in " -." else 10 + ord(c) for c in i])
    return {rule: k for k, rule in enumerate(order)}


def check_ruleset() -> None:
    """Points of a dimension's rules add up to its weight, and weights to 100."""
    for dimension, weight in WEIGHTS.items():
        if sum(r[1] for r in RULES if r[0].startswith(f"{dimension}.")) != weight:
            raise AssertionError(f"{RULESET_VERSION}:{dimension}")
    if sum(WEIGHTS.values()) != 100 or len(set(RULE_IDS)) != len(RULES):
        raise AssertionError(RULESET_VERSION)


check_ruleset()
