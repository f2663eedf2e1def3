"""Detection rules, risk weights, labels and limits.

Everything a user may want to change is plain data here: a rule is a frozen
dataclass, a rule set is a tuple of rules, and every operator takes the rule set
or the options as an argument.  No operator hard-codes a category.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

# Building blocks of the detection patterns.  Java's predefined
# classes differ from the text model used here (\s, \w and \b disagree on separator
# controls, marks and number forms), so the classes are spelled out.  The styled
# letter and digit are members of \p{L} and \p{Nd}; naming them makes Java look
# behind by code points instead of 16-bit units.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_" + "\U0001d400"
DIGIT = r"\p{Nd}"
WORD_START = f"(?<![{WORD}])"
WORD_END = f"(?![{WORD}])"
DIGIT_START = "(?<![" + DIGIT + "\U0001d7ce])"
DIGIT_END = f"(?!{DIGIT})"

@dataclass(frozen=True)
class Gate:
    """A cheap pattern found in every text that has a match of the gated rule.

    ``first`` is the class of its possible first characters.  Gates of one ``group`` are
    tested together in one walk over the text.  Must not contain capturing groups.
    """

    group: str
    first: str
    pattern: str


# Eight digits with nothing but spaces and hyphens between them.
DIGIT_RUN = Gate("shapes", DIGIT, f"{DIGIT}(?:[{SPACE}-]*{DIGIT}){{7}}")
CAPITALS = Gate("shapes", "A-Z", "[A-Z]{5}[0-9]")
AT_SIGN = Gate("shapes", "@", "@")
# A separator behind a secret's keyword and few spaces, or behind many spaces.
SECRET_WORD = Gate(
    "words", ":=",
    "[:=](?<=(?:[kK\u212a][eE][yY]|[tT][oO][kK\u212a][eE][nN]|[bB][eE][aA][rR][eE][rR]|[wW](?:[oO][rR])?[dD])"
    f"[{SPACE}]{{0,9}}[:=]|[{SPACE}]{{10}}[:=])",
)
EMP_WORD = Gate("words", "eE", "[eE][mM](?<![a-zA-Z0-9_][eE][mM])[pP]")


@dataclass(frozen=True)
class Rule:
    """One detection category.

    The pattern is ``before + body + after``; the finding is the body.  Look-arounds
    may sit anywhere, capturing groups nowhere.  Three optional hints make a scan cheap
    and never change its result: ``first`` is a character class that every match starts
    with (tested before any look-behind), ``needs`` lists literals of which a text must
    contain at least one, and ``gate`` is a pattern that a text with a match contains.
    ``mask`` picks the masking style, ``check`` an extra filter.
    """

    category: str
    body: str
    before: str = ""
    after: str = ""
    ignore_case: bool = False
    first: str = ""
    needs: tuple[str, ...] = ()
    gate: Gate | None = None
    check: str | None = None
    mask: str = "edges"
    weight: int = 1
    critical: bool = False
    severity: str = "Standard"
    label: str | None = None

    @property
    def grouped(self) -> bool:
        return bool(self.before or self.after)

    @property
    def pattern(self) -> str:
        start = f"(?=[{self.first}])" if self.first else ""
        flags = "(?iu)" if self.ignore_case else ""
        if not self.grouped:
            return start + flags + self.body
        return f"{start}{flags}({self.before})({self.body}){self.after}"


# The nine built-in categories with their patterns, weights, severity
# classes and display labels.
RULES: tuple[Rule, ...] = (
    Rule(
        "Aadhaar",
        body=f"{DIGIT_START}{DIGIT}{{4}}[{SPACE}-]?{DIGIT}{{4}}[{SPACE}-]?{DIGIT}{{4}}{DIGIT_END}",
        first=DIGIT, gate=DIGIT_RUN, mask="digits", weight=4, severity="Elevated", label="Aadhaar IDs",
    ),
    Rule(
        "PAN",
        body=f"{WORD_START}[A-Z]{{5}}[0-9]{{4}}[A-Z]{WORD_END}",
        first="A-Z", gate=CAPITALS, mask="pan", weight=3, severity="Elevated", label="PAN Numbers",
    ),
    Rule(
        "Email",
        body=(
            f"(?:(?=[A-Za-z0-9_]){WORD_START}|(?=[.%+-])(?<=[{WORD}]))"
            f"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}{WORD_END}"
        ),
        needs=("@",), gate=AT_SIGN, mask="email", weight=1, label="Emails",
    ),
    Rule(
        "Phone",
        body=f"{DIGIT_START}(?:\\+?91[{SPACE}-]?)?[6-9]{DIGIT}{{9}}{DIGIT_END}",
        first="+6-9", gate=DIGIT_RUN, mask="digits", weight=1, label="Phone Numbers",
    ),
    Rule(
        "Credit Card",
        body=f"{DIGIT_START}(?:{DIGIT}[ -]*?){{13,19}}{DIGIT_END}",
        first=DIGIT, gate=DIGIT_RUN, check="luhn", mask="digits", weight=5, critical=True, severity="Critical", label="Credit Cards",
    ),
    Rule(
        "Bank Account",
        before=(
            f"{WORD_START}(?:account(?:[{SPACE}]+number)?|acct(?:[{SPACE}]+no\\.?)?)"
            f"[{SPACE}]*[:#-]?[{SPACE}]*"
        ),
        body=f"{DIGIT}{{9,18}}{WORD_END}",
        ignore_case=True, first="aA", gate=DIGIT_RUN, mask="digits", weight=5, severity="Critical",
        label="Bank Accounts",
    ),
    Rule(
        "API Key",
        before=(
            f"{WORD_START}(?:api[_-]?key|secret[_-]?key|access[_-]?token|bearer)"
            f"[{SPACE}]*[:=][{SPACE}]*['\"]?"
        ),
        body=r"[A-Za-z0-9_\-]{20,}",
        after="['\"]?",
        ignore_case=True, first="aAbBsS\u017f", needs=(":", "="), gate=SECRET_WORD, mask="secret",
        weight=5, critical=True, severity="Critical", label="API Keys",
    ),
    Rule(
        "Password",
        before=f"{WORD_START}(?:password|passwd|pwd)[{SPACE}]*[:=][{SPACE}]*['\"]?",
        body=f"[^{SPACE},'\"]{{6,}}",
        after="['\"]?",
        ignore_case=True, first="pP", needs=(":", "="), gate=SECRET_WORD, mask="secret", weight=5,
        severity="Critical", label="Passwords",
    ),
    Rule(
        "Employee ID",
        body=f"{WORD_START}(?:EMP|Employee ID|EmployeeID)[{SPACE}:-]*[A-Za-z0-9]{{3,12}}{WORD_END}",
        ignore_case=True, first="eE", gate=EMP_WORD, mask="edges", weight=2, severity="Elevated", label="Employee IDs",
    ),
)

# Display label and tone of each risk level.
LEVEL_THEMES: tuple[tuple[str, str, str], ...] = (
    ("Low", "Low Threat", "Emerald"),
    ("Medium", "Medium Threat", "Amber"),
    ("High", "High Threat", "Crimson"),
    ("Unknown", "Unclassified", "Slate"),
)

# The order in which critical categories are named in a risk reason.
CRITICAL_ORDER: tuple[str, ...] = ("API Key", "Credit Card")


@dataclass(frozen=True)
class Options:
    """Limits and thresholds; the defaults are the fixed values of the product."""

    allowed_extensions: tuple[str, ...] = (".pdf", ".txt", ".csv")
    max_upload_mb: int = 20
    max_input_chars: int = 12000
    high_threshold: int = 10
    medium_min: int = 4
    sensitive_count_threshold: int = 5
    chunk_size: int = 1000
    chunk_overlap: int = 150
    retriever_k: int = 4
    sentence_limit: int = 4
    sentence_chars: int = 600
    source_chars: int = 1600
    excerpt_chars: int = 900
    context_short: int = 180
    context_chars: int = 260
    risk_chars: int = 360


DEFAULT_OPTIONS = Options()


def critical_categories(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """Critical categories in naming order; user rules follow the built-in ones."""
    named = [r.category for r in rules if r.critical]
    fixed = [c for c in CRITICAL_ORDER if c in named]
    return fixed + [c for c in named if c not in fixed]


def with_rules(*extra: Rule, rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rule set with ``extra`` added; a rule replaces one of the same category."""
    names = {r.category for r in extra}
    return tuple(r for r in rules if r.category not in names) + extra


def rule_from_row(row: dict) -> Rule:
    """Rule from one row of a rule table (missing or null fields keep defaults)."""
    known = {k: v for k, v in row.items() if v is not None and k in Rule.__dataclass_fields__}
    if "needs" in known:
        known["needs"] = tuple(known["needs"])
    return replace(Rule(category=known["category"], body=known["body"]), **known)


MAX_RULES = 1000


def rules_from_table(table: DataFrame) -> tuple[Rule, ...]:
    """Rules from a rule table, one per row, columns named as the fields of ``Rule``.

    Rules shape the plan, so they are read at planning time; a table with more rows than
    a rule set can have is refused rather than collected.
    """
    rows = table.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"a rule table may hold at most {MAX_RULES} rules")
    return tuple(sorted((rule_from_row(r.asDict()) for r in rows), key=lambda r: r.category))


def category_dim(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per rule: category, weight, critical, label, severity."""
    rows = [(r.category, r.weight, r.critical, r.label or r.category, r.severity) for r in rules]
    return spark.createDataFrame(
        rows, "category string, weight int, critical boolean, label string, severity string"
    )


def risk_level_dim(spark: SparkSession) -> DataFrame:
    """One row per risk level: risk_level, level_label, tone."""
    return spark.createDataFrame(list(LEVEL_THEMES), "risk_level string, level_label string, tone string")
