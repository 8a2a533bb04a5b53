"""Postings, profiles, resumes, addresses and dates derived from the driver tables, in Spark and in SQL.

The tables hold no postings, so each row of a table picks phrases by its key, in both engines from the same lists.
What the queries make of the texts is computed in each engine by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(x) -> str:
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(quoted, x)) + "]"
    if isinstance(x, dict):
        return "{" + ", ".join(f"'{k}': {quoted(v)}" for k, v in x.items()) + "}"
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


class Pick:
    """An entry of a list, by a * key + b."""

    def __init__(self, options: list, a: int = 1, b: int = 0):
        self.options, self.a, self.b = options, a, b

    def column(self, key: str) -> Column:
        def lit(x) -> str:
            if isinstance(x, (list, tuple)):
                return f"array({', '.join(map(lit, x))})"
            if isinstance(x, dict):
                return f"named_struct({', '.join(f'{lit(k)}, {lit(v)}' for k, v in x.items())})"
            return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else quoted(x)

        return F.expr(f"get({lit(self.options)}, cast(pmod({key} * {self.a} + {self.b}, {len(self.options)}) as int))")

    def sql(self, key: str) -> str:
        return f"{quoted(self.options)}[CAST(({key} * {self.a} + {self.b}) % {len(self.options)} AS INTEGER) + 1]"


def columns(picks: dict[str, Pick], key: str) -> list[Column]:
    return [p.column(key).alias(name) for name, p in picks.items()]


def columns_sql(picks: dict[str, Pick], key: str) -> str:
    return ", ".join(f"{p.sql(key)} AS {name}" for name, p in picks.items())


# ---- postings: one for each customer ---------------------------------------------------------------------------

POST = {
    "title": Pick(["Senior Frontend Engineer", "Platform Developer", "Staff Engineer", "Account Executive", "UI Engineer", "Engineering Intern", "Product Designer", "Senior Web Engineer, Growth", "Principal Architect", "Recruiter", "Full Stack Developer", "Data Scientist", "Internal Tools Engineer"], 1),
    "location": Pick(["Remote - Canada", "Toronto, ON", "New York", "Berlin", "Remote", "San Francisco, CA", "Montréal", "", "Anywhere", "Calgary, Alberta", "London (UK only)"], 3, 1),
    "workplace": Pick(["remote", "hybrid", "on_site", "unknown", "remote"], 7, 2),
}
_LINES = {
    "_intro": Pick(["We build tools for teams.", "Open to US only applicants.", "Join our EMEA team and work from anywhere.", "Canada only. We ask for a degree.", "Build things that people use", "Our office is the place to be.", "You must be eligible to work in Canada, on-site only"], 1, 3),
    "_required_head": Pick(["Required:", "Must have", "Minimum qualifications", "What you'll need", None], 5, 1),
    "_required_1": Pick(["- 5+ years of React and TypeScript experience", "• Must be authorized to work in Canada", "* Experience with GraphQL and Apollo servers", "- 12+ years building Java services", "- Kubernetes and AWS in production, required", "- Strong communication habits", "- Bachelor degree in any field, mandatory", "- short"], 1),
    "_required_2": Pick(["- Must hold an active security clearance", "- Fluent French language skills required", "- Vue or Angular background", "- Minimum 3 years with Node.js", "- Python and Docker knowledge", "- Must be located in Vancouver", "- End to end testing with Playwright", "- Rust or C# on the server", "- Visa sponsorship is not offered"], 3, 2),
    "_preferred_head": Pick(["Nice to have", "Preferred", "Bonus", None], 3),
    "_preferred_1": Pick(["- Tailwind and Redux styling work", "- k8s operations background", "- Knowledge of figma files", "- MongoDB or PostgreSQL modelling", "- Spanish language is a plus", "- Accessibility and WCAG audits"], 5, 4),
    "_duty_head": Pick(["Responsibilities", "What you'll do", "Your role", None], 7, 1),
    "_duty_1": Pick(["Improve frontend performance and testing coverage", "Lead accessible interface delivery work", "Deploy services to AWS every week", "Talk with clients about their plans", "Mentor people across several groups"], 1, 2),
    "_duty_2": Pick(["- Own the dashboards used by clients", "- Write documents that colleagues understand", "- Migrate Angular screens to React", None], 5, 3),
    "_end": Pick(["We are an equal employer.", "Visa support: candidates must be eligible to work in Canada or the US.", "Experience with Firebase helps.", "10+ years of experience.", None, "Apply today"], 1, 5),
}
PROFILE = {
    "years": Pick([7, 3, None, 12, 5], 1),
    "remote_preference": Pick(["remote", "hybrid", "flexible", "remote"], 3, 1),
    "preferred_locations": Pick([["Toronto"], [], ["New York", "Berlin"], ["Vancouver", "Calgary"]], 1, 2),
    "skills": Pick([["React", "TypeScript", "JS"], ["Java", "Go"], ["nextjs", "ts", "GraphQL", "Tailwind"], ["Python", "AWS", "k8s"], ["javascript", "Node", "Playwright"], [], ["react.js", "Redux", "MUI", "wcag"]], 1, 1),
    "evidence": Pick(
        [
            [{"id": "e0", "text": "Built accessible React apps with testing", "skills": ["react", "a11y"]}, {"id": "e1", "text": "Led delivery of dashboards used by clients", "skills": []}],
            [{"id": "e0", "text": "Migrated services to AWS with Docker", "skills": ["AWS", "docker"]}],
            [],
            [{"id": "e0", "text": "Improved performance of GraphQL servers", "skills": ["graphql", "apollo"]}, {"id": "e1", "text": "Mentored groups, wrote documents", "skills": ["TS"]}],
        ],
        1,
        3,
    ),
}


KEYS_A_TASK = 50_000


def spread(keys: DataFrame, key: str) -> DataFrame:
    """Keys dealt to several tasks a core, and to more where a task would get over KEYS_A_TASK on average, so that its memory doesn't
    grow with the table. A column of keys is small, so it is read in few tasks, or in one where the file has one row group; but the
    texts made of each key are work. What is then put together by key needs no other exchange. Rows are counted from the file's footers."""
    tasks = -(-keys.count() // KEYS_A_TASK)
    return keys.repartition(max(4 * keys.sparkSession.sparkContext.defaultParallelism, tasks), key)


def _customers(spark, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id")), "id")


def posts(spark, sf_dir: str) -> DataFrame:
    """id, title, location, workplace and description."""
    d = _customers(spark, sf_dir).select("id", *columns(POST | _LINES, "id"))
    return d.withColumn("description", F.concat_ws("\n", *_LINES)).drop(*_LINES)


POSTS_SQL = f"SELECT id, title, location, workplace, concat_ws(chr(10), {', '.join(_LINES)}) AS description FROM (SELECT c_custkey AS id, {columns_sql(POST | _LINES, 'c_custkey')} FROM customer)"


def with_profile(d: DataFrame) -> DataFrame:
    """d with a candidate's profile for each row, by its id."""
    none = F.array().cast("array<struct<id:string,text:string,skills:array<string>>>")
    made = {k: p.column("id") for k, p in PROFILE.items()}
    made["evidence"] = F.coalesce(made["evidence"], none)
    return d.withColumn("profile", F.struct(*(c.alias(k) for k, c in made.items())))


PROFILES_SQL = f"SELECT c_custkey AS id, {columns_sql(PROFILE, 'c_custkey')} FROM customer"
