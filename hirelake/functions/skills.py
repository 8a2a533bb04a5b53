"""Skills named in text, and their canonical names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords looked for, synonyms of skills, and skills that matter in scoring.
TECH_KEYWORDS = [
    "react", "typescript", "javascript", "next.js", "nextjs", "node.js", "nodejs", "graphql", "apollo", "tailwind", "playwright", "vitest", "redux", "zustand",
    "vue", "angular", "java", "kubernetes", "k8s", "aws", "docker", "python", "go", "rust", "c#", ".net", "spring", "postgresql", "mongodb", "firebase",
    "accessibility", "wcag", "figma", "mui", "shadcn",
]
SYNONYMS = {
    "react": ["react.js", "reactjs"],
    "typescript": ["ts"],
    "javascript": ["js", "ecmascript"],
    "next.js": ["nextjs", "next"],
    "node.js": ["nodejs", "node"],
    "playwright": ["e2e testing", "end-to-end testing"],
    "kubernetes": ["k8s"],
    "accessibility": ["a11y", "wcag"],
}
CANONICAL = {s: name for name, others in SYNONYMS.items() for s in others}


def constant(x) -> Column:
    """A list or a dict of plain strings as one expression."""
    text = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"map({', '.join(text(v) for kv in x.items() for v in kv)})" if isinstance(x, dict) else f"array({', '.join(map(text, x))})")


def canonical_skill(col: Column) -> Column:
    """Lower case, trimmed, synonyms to one name."""
    low = F.trim(F.lower(col))
    return F.coalesce(F.try_element_at(constant(CANONICAL), low), low)


def technologies(col: Column, keywords: list[str] = TECH_KEYWORDS) -> Column:
    """Canonical names of the keywords that occur anywhere in the text, in keyword order."""
    # within the outer transform the text is put into lower case once, not once for each keyword
    found = F.get(F.transform(F.array(F.lower(col)), lambda low: F.filter(constant(keywords), lambda k: F.contains(low, k))), 0)
    return F.array_distinct(F.transform(found, canonical_skill))
