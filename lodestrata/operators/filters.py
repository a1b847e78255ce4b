"""Declarative line filters: which commands they are for, and what is done to the lines, in a fixed order of stages."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regexes import to_java
from . import lines as L


@dataclass
class FilterSpec:
    name: str
    match: str
    strip_ansi: bool = False
    dedup_consecutive: bool = False
    replace: list[tuple[str, str]] = field(default_factory=list)
    keep_lines: str | None = None
    drop_lines: str | None = None
    truncate_at: int | None = None
    head: int | None = None
    tail: int | None = None
    max_lines: int | None = None
    on_empty: str | None = None

    def __post_init__(self) -> None:
        if self.keep_lines and self.drop_lines:
            raise ValueError(f"{self.name}: keep_lines and drop_lines exclude each other")
        to_java(self.match)

    def apply(self, lines: DataFrame) -> DataFrame:
        """lines(doc_id, line_no, line) after all stages. A text of which nothing is left gets the on_empty line."""
        texts = lines.select("doc_id").distinct() if self.on_empty is not None else None
        out = lines.select("doc_id", "line_no", "line")
        if self.strip_ansi:
            out = out.withColumn("line", L.strip_ansi(F.col("line")))
        if self.dedup_consecutive:
            out = L.dedup_consecutive(out)
        if self.replace:
            out = L.replace_lines(out, self.replace)
        if self.keep_lines:
            out = L.keep_lines(out, [self.keep_lines])
        elif self.drop_lines:
            out = L.drop_lines(out, [self.drop_lines])
        if self.truncate_at:
            out = out.withColumn("line", L.truncate(F.col("line"), self.truncate_at))
        if self.head:
            out = L.head(out, self.head)
        if self.tail:
            out = L.tail(out, self.tail)
        if self.max_lines:
            out = L.cap(out, self.max_lines)
        if texts is not None:
            empty = texts.join(out.where("trim(line) <> ''").select("doc_id").distinct(), "doc_id", "left_anti")
            stays = out.join(empty, "doc_id", "left_anti")
            out = stays.unionByName(empty.select("doc_id", F.lit(1).alias("line_no"), F.lit(self.on_empty).alias("line")))
        return L.collapse_blank(out)


def from_toml(text: str) -> list[FilterSpec]:
    """The filters of a TOML document with [[filters]] tables; replace rules are tables with find and with."""
    out = []
    for f in tomllib.loads(text).get("filters", []):
        rules = [(r["find"], r["with"]) for r in f.pop("replace", [])]
        out.append(FilterSpec(**f, replace=rules))
    return out


#: Filters that come with the library, tried in this order after the user's own.
BUILT_IN = [
    FilterSpec("unit-tests", r"^(pytest|python -m pytest|tox|nose2)", True, keep_lines=r"(^FAILED|^ERROR|^E |Traceback|\d+ (failed|passed|errors?))", max_lines=80, on_empty="All tests passed"),
    FilterSpec("js-tests", r"^(npx )?(jest|vitest|mocha)", True, dedup_consecutive=True, keep_lines=r"(FAIL|✕|●|Tests?:|Suites?:)", max_lines=80, on_empty="All tests passed"),
    FilterSpec("cargo-build", r"^cargo (build|check|clippy)", True, drop_lines=r"^\s*(Compiling|Downloading|Downloaded|Checking|Fresh|Finished) ", truncate_at=200, max_lines=80, on_empty="Build ok"),
    FilterSpec("cargo-test", r"^cargo (test|nextest)", True, keep_lines=r"(^test result|FAILED|panicked|^error|^failures)", max_lines=80, on_empty="All tests passed"),
    FilterSpec("go", r"^go (build|test|vet)", True, keep_lines=r"(FAIL|^ok|panic|\.go:\d+)", max_lines=60, on_empty="Go ok"),
    FilterSpec("compilers", r"^(make|cmake|ninja|gcc|clang|mvn|gradle)", True, keep_lines=r"(?i)(error|warning|undefined|\*\*\*|BUILD)", truncate_at=200, max_lines=60, on_empty="Build ok"),
    FilterSpec("type-checkers", r"^(mypy|tsc|pyright|npx tsc)", True, keep_lines=r"(error|note:|Found \d+)", truncate_at=200, max_lines=60, on_empty="No type errors"),
    FilterSpec("linters", r"^(ruff|eslint|biome|flake8|pylint|shellcheck|golangci-lint)", True, keep_lines=r"(:\d+|error|warning|problems?)", truncate_at=200, max_lines=60, on_empty="No lint errors"),
    FilterSpec("formatters", r"^(black|prettier|gofmt|rustfmt)", True, keep_lines=r"(reformatted|would|error|changed|unchanged)", max_lines=40, on_empty="Formatted"),
    FilterSpec("installers", r"^(pip|pip3|uv pip|npm|pnpm|yarn|poetry|bundle|composer|brew|apt|apt-get) (install|add|update)", True, keep_lines=r"(?i)(success|installed|added|already|error|warn|fail|vulnerab)", max_lines=30, on_empty="Installed"),
    FilterSpec("container-list", r"^docker (ps|images|compose ps)", True, replace=[(r" {2,}", "  ")], max_lines=30),
    FilterSpec("container-logs", r"^(docker|kubectl|podman) logs", True, dedup_consecutive=True, replace=[(r"^\d{4}-\d{2}-\d{2}T[\d:.]+Z?\s*", "")], tail=25),
    FilterSpec("container-build", r"^(docker|podman) build", True, keep_lines=r"(?i)^(step|error|#\d+)", max_lines=60),
    FilterSpec("cluster", r"^(kubectl|helm|oc) ", True, truncate_at=160, max_lines=60),
    FilterSpec("plans", r"^(terraform|tofu|pulumi) (plan|preview|apply)", True, keep_lines=r"(^\s*[#~+-]|Plan:|Error|Warning|No changes|complete)", max_lines=80, on_empty="No changes"),
    FilterSpec("ansible", r"^ansible", True, keep_lines=r"(TASK|PLAY|fatal|failed|changed|unreachable)", max_lines=60),
    FilterSpec("git-sync", r"^git (fetch|pull|push|clone)", True, drop_lines=r"^(remote: )?(Counting|Compressing|Enumerating|Resolving|Unpacking|Receiving|Writing)", max_lines=30, on_empty="Up to date"),
    FilterSpec("forge", r"^(gh|glab) ", True, truncate_at=160, max_lines=40),
    FilterSpec("cloud", r"^(aws|gcloud|az) ", True, truncate_at=200, max_lines=80),
    FilterSpec("sql-shell", r"^(psql|mysql|sqlite3|duckdb)", True, drop_lines=r"^[-+|\s]*$", truncate_at=200, max_lines=60),
    FilterSpec("downloads", r"^(curl|wget)", True, drop_lines=r"^\s*\d+\s+\d+.*--:--", truncate_at=300, max_lines=80),
    FilterSpec("processes", r"^(ps|top|df|du)\b", True, truncate_at=160, max_lines=40),
    FilterSpec("services", r"^(systemctl|journalctl|service) ", True, dedup_consecutive=True, truncate_at=200, tail=40),
    FilterSpec("sync", r"^(rsync|scp)", True, drop_lines=r"(to-chk=|kB/s|MB/s)", tail=20, on_empty="Synced"),
    FilterSpec("ping", r"^ping", True, keep_lines=r"(statistics|packets|rtt|round-trip|unreachable)", on_empty="No answer"),
    FilterSpec("dotnet", r"^dotnet (build|test|restore)", True, keep_lines=r"(error|warning|Passed|Failed|Build)", truncate_at=200, max_lines=60, on_empty="Build ok"),
    FilterSpec("ruby-tests", r"^(bundle exec )?(rspec|rake test)", True, keep_lines=r"(Failure|rspec |examples?,|Error)", max_lines=60, on_empty="All tests passed"),
    FilterSpec("php-tests", r"^(vendor/bin/)?(phpunit|pest)", True, keep_lines=r"(FAIL|Tests:|Error|OK)", max_lines=60, on_empty="All tests passed"),
    FilterSpec("e2e-tests", r"^(npx )?(playwright|cypress)", True, keep_lines=r"(✘|failed|passed|Error|Timeout)", max_lines=60, on_empty="All tests passed"),
    FilterSpec("monorepo", r"^(npx )?(nx|turbo|lerna) ", True, keep_lines=r"(?i)(error|fail|success|tasks?:|cached)", max_lines=60, on_empty="Tasks ok"),
    FilterSpec("cargo-audit", r"^cargo (audit|deny)", True, keep_lines=r"(?i)(^crate|^version|^title|^id:|vulnerab|warning|error)", max_lines=60, on_empty="No advisories"),
    FilterSpec("go-modules", r"^go (mod|get)", True, drop_lines=r"^go: (downloading|extracting|finding)", max_lines=40, on_empty="Modules ok"),
    FilterSpec("jvm-tests", r"^(mvn|gradle|\./gradlew|\./mvnw) .*(test|verify)", True, keep_lines=r"(Tests run|FAIL|ERROR|BUILD|tests completed)", max_lines=60, on_empty="All tests passed"),
    FilterSpec("swift", r"^swift (build|test)", True, keep_lines=r"(error:|warning:|Compiling failed|passed|failed|Build complete)", max_lines=60, on_empty="Build ok"),
    FilterSpec("elixir", r"^mix ", True, keep_lines=r"(?i)(error|warning|\d+ tests?|failures?|compiled)", max_lines=60, on_empty="Mix ok"),
    FilterSpec("bun", r"^bun (test|run|install)", True, keep_lines=r"(?i)(fail|error|pass|installed|\d+ tests?)", max_lines=60, on_empty="Bun ok"),
    FilterSpec("web-builds", r"^(npx )?(next|vite|webpack|rollup|esbuild|astro) ?(build)?", True, keep_lines=r"(?i)(error|warn|fail|built in|compiled|bundle|kB)", truncate_at=160, max_lines=60, on_empty="Build ok"),
    FilterSpec("schema-tools", r"^(npx )?(prisma|drizzle-kit|alembic|flyway)", True, keep_lines=r"(?i)(error|migrat|generated|applied|warn|sync)", max_lines=40),
    FilterSpec("scripts", r"^(npm|pnpm|yarn) (run|exec|start)", True, drop_lines=r"^(> |npm (notice|warn))", truncate_at=200, max_lines=80),
    FilterSpec("package-lists", r"^(pnpm|npm|pip|uv pip|cargo|brew) (list|ls|freeze|tree|outdated)", True, truncate_at=120, max_lines=60),
    FilterSpec("uv", r"^uv (sync|lock|run|add|remove)", True, drop_lines=r"^\s*(Downloading|Downloaded|Building|Built|Prepared)", max_lines=40, on_empty="Up to date"),
    FilterSpec("poetry", r"^poetry (lock|run|show)", True, truncate_at=160, max_lines=60),
    FilterSpec("composer", r"^composer ", True, keep_lines=r"(?i)(installing|updating|error|warning|nothing|problem)", max_lines=40, on_empty="Nothing to do"),
    FilterSpec("boards", r"^(pio|platformio|arduino-cli) ", True, keep_lines=r"(?i)(error|warning|success|failed|ram:|flash:)", max_lines=40),
    FilterSpec("yaml-markdown", r"^(yamllint|markdownlint|hadolint|actionlint|vale)", True, keep_lines=r"(:\d+|error|warning)", truncate_at=200, max_lines=60, on_empty="No lint errors"),
    FilterSpec("hooks", r"^(pre-commit|trunk|lefthook|husky)", True, keep_lines=r"(?i)(failed|error|fixed|passed|issues?)", max_lines=60, on_empty="Hooks ok"),
    FilterSpec("rubocop", r"^(bundle exec )?rubocop", True, keep_lines=r"(:\d+:\d+:|offenses?|Inspecting)", truncate_at=200, max_lines=60, on_empty="No offenses"),
    FilterSpec("helm", r"^helm (list|status|install|upgrade|lint|diff|template)", True, truncate_at=160, max_lines=60),
    FilterSpec("cluster-apply", r"^kubectl (apply|delete|rollout|scale)", True, keep_lines=r"(?i)(created|configured|unchanged|deleted|error|success|waiting)", max_lines=40),
    FilterSpec("cluster-describe", r"^kubectl describe", True, drop_lines=r"^\s*(Annotations|Tolerations|QoS Class|Node-Selectors):", truncate_at=160, max_lines=80),
    FilterSpec("cluster-events", r"^kubectl (get events|events|top)", True, dedup_consecutive=True, truncate_at=160, tail=40),
    FilterSpec("compose", r"^docker(-| )compose (up|down|build|pull)", True, drop_lines=r"(Pulling|Waiting|Downloading|Extracting|Verifying)", max_lines=40),
    FilterSpec("plan-checks", r"^(terraform|tofu) (init|validate|fmt|providers)", True, keep_lines=r"(?i)(error|warning|success|initialized|installed)", max_lines=30, on_empty="Valid"),
    FilterSpec("stash-worktree", r"^git (stash|worktree|remote|tag|branch)", True, truncate_at=120, max_lines=40),
    FilterSpec("workflow-runs", r"^gh (workflow|run) ", True, keep_lines=r"(?i)(completed|failure|success|in_progress|queued|X |✓)", truncate_at=160, max_lines=40),
    FilterSpec("cloud-logs", r"^(aws logs|gcloud logging|az monitor)", True, dedup_consecutive=True, truncate_at=200, tail=40),
    FilterSpec("cloud-storage", r"^(aws s3|gsutil|gcloud storage|az storage)", True, drop_lines=r"(Completed \d|MiB/s|KiB/s)", tail=30),
    FilterSpec("cloud-stacks", r"^(aws cloudformation|sam|cdk|serverless)", True, keep_lines=r"(?i)(_COMPLETE|_FAILED|ROLLBACK|error|output)", truncate_at=160, max_lines=60),
    FilterSpec("differences", r"^(diff|git diff --stat|delta)", True, truncate_at=200, max_lines=120),
    FilterSpec("counts", r"^(wc|nproc|uptime|free)", True, max_lines=20),
    FilterSpec("environment", r"^(env|printenv|set)$", True, replace=[(r"(?i)^([A-Z0-9_]*(KEY|SECRET|TOKEN|PASS)[A-Z0-9_]*=).*", "$1****")], max_lines=60),
    FilterSpec("network", r"^(netstat|ss|ip|ifconfig|dig|nslookup|traceroute)\b", True, truncate_at=160, max_lines=40),
    FilterSpec("typos", r"^(typos|codespell|cspell)", True, keep_lines=r"(-->|==>|:\d+|Unknown word)", max_lines=60, on_empty="No typos"),
    FilterSpec("security", r"^(trivy|grype|snyk|bandit|semgrep|gitleaks)", True, keep_lines=r"(?i)(critical|high|medium|issue|finding|vulnerab|leak|total)", truncate_at=200, max_lines=60, on_empty="No findings"),
    FilterSpec("coverage", r"^(coverage|nyc|c8|lcov|tarpaulin)", True, keep_lines=r"(?i)(total|all files|\d+(\.\d+)?%)", max_lines=60),
    FilterSpec("benchmarks", r"^(hyperfine|criterion|cargo bench|wrk|ab) ?", True, keep_lines=r"(?i)(mean|range|time:|req/sec|latency|faster|slower)", max_lines=40),
    FilterSpec("documents", r"^(mdbook|mkdocs|sphinx-build|typedoc|javadoc)", True, keep_lines=r"(?i)(error|warning|built|success)", max_lines=40, on_empty="Built"),
    FilterSpec("archives", r"^(tar|zip|unzip|7z) ", True, head=20),
    FilterSpec("migrations", r"^(rails|rake|bin/rails) db:", True, keep_lines=r"(?i)(migrat|error|==|rolled)", max_lines=40, on_empty="Up to date"),
    FilterSpec("notebooks", r"^(jupyter|papermill|quarto) ", True, keep_lines=r"(?i)(error|executing|exception|output)", max_lines=40),
]


class Registry:
    """Filters in the order they are tried: the user's, the trusted project's, then the built-in ones; the first match wins."""

    def __init__(self, user: list[FilterSpec] = (), project: list[FilterSpec] = ()):
        self.filters = [*user, *project, *BUILT_IN]

    def find(self, command: str) -> FilterSpec | None:
        import re

        base = normalised_command(command)
        for text in (command, base):
            for f in self.filters:
                if re.search(f.match, text):
                    return f
        return None

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, f.name, to_java(f.match)) for i, f in enumerate(self.filters)], "ord int, filter string, pattern string")


def normalised_command(command: str) -> str:
    """The first word without its folders."""
    first, _, rest = command.strip().partition(" ")
    return " ".join(x for x in (first.rsplit("/", 1)[-1], rest) if x)


def match_commands(commands: DataFrame, registry: Registry) -> DataFrame:
    """command, filter: the first filter whose pattern matches each command (null: none). One expression, so no join is needed."""
    base = F.regexp_replace(F.trim("command"), r"^[^ ]*/", "")
    found = F.lit(None).cast("string")
    for f in reversed(registry.filters):
        found = F.when(F.rlike("command", F.lit(to_java(f.match))) | F.rlike(base, F.lit(to_java(f.match))), F.lit(f.name)).otherwise(found)
    return commands.select("command", found.alias("filter"))
