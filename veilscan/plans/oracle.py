"""DuckDB SQL with the same answer as each registered query.

The statements are built from shared common table expressions.  DuckDB's regex engine
has no look-around, so patterns that need it are replaced by forms that find the same
values in the given tables; values and offsets are compared, not only counts.
"""

from __future__ import annotations

from veilscan.functions import narrative as N
from veilscan.functions import text as T
from veilscan.operators import questions as Q
from veilscan.plans import corpora as C
from veilscan.sources.uploads import PDF_MESSAGE

NL = "chr(10)"


def lit(value: str) -> str:
    """SQL expression for a string that may hold quotes and newlines."""
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def fill(template: str, *args: str) -> str:
    """SQL concatenation for a %s/%d template."""
    pieces = template.replace("%d", "%s").split("%s")
    out = [lit(pieces[0])]
    for arg, piece in zip(args, pieces[1:], strict=True):
        out += [f"cast({arg} as varchar)", lit(piece)]
    return "(" + " || ".join(out) + ")"


def duck(sql: str) -> str:
    """Spark suffix SQL as DuckDB SQL."""
    return sql.replace("'\\n'", NL).replace("as string", "as varchar")


# The patterns of the nine categories, in forms that this regex engine has.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
CARD = "[0-9]{13,19}"
AADHAAR = r"(?:^|[^0-9])([0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4})(?:[^0-9]|$)"
PHONE = r"(?:^|[^0-9])((?:\+?91[\s-]?)?[6-9][0-9]{9})(?:[^0-9]|$)"
PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
BANK = r"(?i)\b(?:account(?:\s+number)?|acct(?:\s+no\.?)?)\s*[:#-]?\s*([0-9]{9,18})\b"
API_KEY = r"""(?i)\b(?:api[_-]?key|secret[_-]?key|access[_-]?token|bearer)\s*[:=]\s*['"]?([A-Za-z0-9_\-]{20,})['"]?"""
PASSWORD = r"""(?i)\b(?:password|passwd|pwd)\s*[:=]\s*['"]?([^\s,'"]{6,})['"]?"""
EMPLOYEE = r"(?i)\b(?:EMP|Employee ID|EmployeeID)[\s:-]*[A-Z0-9]{3,12}\b"

# How each category is masked, its weight, label and severity.
STYLE = {
    "Aadhaar": "digits", "Phone": "digits", "Credit Card": "digits", "Bank Account": "digits",
    "PAN": "pan", "Email": "email", "API Key": "secret", "Password": "secret", "Employee ID": "edges",
    "Other": "edges",
}
DIM = [  # category, weight, critical, label, severity
    ("Aadhaar", 4, False, "Aadhaar IDs", "Elevated"),
    ("PAN", 3, False, "PAN Numbers", "Elevated"),
    ("Email", 1, False, "Emails", "Standard"),
    ("Phone", 1, False, "Phone Numbers", "Standard"),
    ("Credit Card", 5, True, "Credit Cards", "Critical"),
    ("Bank Account", 5, False, "Bank Accounts", "Critical"),
    ("API Key", 5, True, "API Keys", "Critical"),
    ("Password", 5, False, "Passwords", "Critical"),
    ("Employee ID", 2, False, "Employee IDs", "Elevated"),
]
DIM_SQL = "dim(category, weight, critical, label, severity) as (values " + ", ".join(
    f"('{c}', {w}, {str(k).lower()}, '{l}', '{s}')" for c, w, k, l, s in DIM
) + ")"


def luhn(v: str) -> str:
    """Luhn test of a string of ASCII digits."""
    digit = f"cast(substr({v}, length({v}) - i::int, 1) as int)"
    return (
        f"(list_sum(list_transform(range(0, length({v})), lambda i: case when i % 2 = 0 then {digit} "
        f"when {digit} > 4 then 2 * {digit} - 9 else 2 * {digit} end)) % 10 = 0)"
    )


def mask(category: str, v: str) -> str:
    """Mask of a value by its category."""
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    n = f"length({v})"
    local = f"split_part({v}, '@', 1)"
    seen = f"(case when length({local}) > 2 then 2 else least(1, length({local})) end)"
    edges = (
        f"(case when {n} <= 4 then repeat('*', {n}) else left({v}, 2) || "
        f"repeat('*', greatest(3, {n} - 4)) || right({v}, 2) end)"
    )
    forms = {
        "digits": f"case when length({d}) >= 4 then repeat('X', length({d}) - 4) || right({d}, 4) else {edges} end",
        "pan": f"case when {n} >= 10 then left({v}, 3) || '****' || right({v}, 3) else repeat('*', {n}) end",
        "email": (
            f"case when contains({v}, '@') then left({local}, {seen}) || "
            f"repeat('*', greatest(4, length({local}) - {seen})) || substr({v}, length({local}) + 1) else {edges} end"
        ),
        "secret": (
            f"case when {n} > 8 then left({v}, 3) || repeat('*', greatest(6, {n} - 6)) || right({v}, 3) "
            f"else repeat('*', {n}) end"
        ),
        "edges": edges,
    }
    arms = " ".join(f"when '{c}' then {forms[s]}" for c, s in STYLE.items())
    return f"(case when {v} = '' then '' else case {category} {arms} end end)"


def docs(suffix: str = "''", extra: str = "") -> str:
    """CTE d(doc_id, body, tail, text): documents with a suffix."""
    return f"d as (select *, body || tail as text from (select doc_id, text as body, {suffix} as tail{extra} from documents))"


PLAIN = docs()
AUGMENTED = docs(duck(C.full_suffix()))
MIXED = docs(duck(C.mixed_suffix()))
MIXED_LANG = docs(duck(C.mixed_suffix()), ", lang")
BLANKS = (
    "d as (select doc_id, text as body, '' as tail, text, lang from documents union all "
    "select -doc_id - 1, '', '', case quality when 0 then ' ' || chr(10) || chr(9) else ' ' || chr(160) || ' ' end, "
    "'none' from labels)"
)


def spans(column: str, category: str, pattern: str, group: int = 0, where: str = "first") -> str:
    """Matches of a pattern with the start of their value in ``column``.

    Offsets are sums of the lengths of gaps and matches; inside its match the value is
    the first or the last occurrence of itself.
    """
    p = lit(pattern)
    inside = {
        "first": "strpos(hit, value) - 1",
        "last": "length(hit) - strpos(reverse(hit), reverse(value)) - length(value) + 1",
    }[where]
    return (
        f"select doc_id, '{category}' as category, value, (ofs + {inside})::int as start from "
        f"(select doc_id, ofs, hit, vs[i] as value from "
        f"(select doc_id, i, vs, ms[i] as hit, list_sum(list_transform(gs[1:i], lambda g: length(g))) + "
        f"coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0) as ofs "
        f"from (select doc_id, ms, vs, gs, unnest(range(1, len(ms) + 1)) as i from "
        f"(select doc_id, regexp_extract_all({column}, {p}) as ms, regexp_extract_all({column}, {p}, {group}) as vs, "
        f"string_split_regex({column}, {p}) as gs from d))))"
    )


EMAIL_SPANS = spans("text", "Email", EMAIL)
CARD_SPANS = f"select * from ({spans('body', 'Credit Card', CARD)}) where {luhn('value')}"
ALL_SPANS = " union all ".join([
    EMAIL_SPANS,
    CARD_SPANS,
    spans("text", "Aadhaar", AADHAAR, 1),
    spans("text", "Phone", PHONE, 1),
    spans("text", "PAN", PAN),
    spans("text", "Bank Account", BANK, 1, "last"),
    spans("text", "API Key", API_KEY, 1, "last"),
    spans("text", "Password", PASSWORD, 1, "last"),
    spans("text", "Employee ID", EMPLOYEE),
])
F_ALL = f"f as ({ALL_SPANS})"
F_PAGES = f"f as ({EMAIL_SPANS} union all {CARD_SPANS})"
MASKED_VALUE = mask("category", "value")
FINDING = f"doc_id, category, value, {MASKED_VALUE} as masked_value, start, (start + length(value))::int as \"end\", 'High' as confidence"

CNT = "cnt as (select doc_id, category, count(*)::int as n from f group by all)"
LISTS = (
    "lists as (select doc_id, sum(n)::int as items, sum(n * weight)::int as score, "
    "string_agg('- ' || category || ': ' || n, chr(10) order by category) as lines, "
    "string_agg(category, ', ' order by category) as names, "
    "string_agg('\"' || category || '\": ' || n, ', ' order by category) as json, "
    "string_agg(case when critical then category end, ', ' order by category) as hits "
    "from cnt join dim using (category) group by doc_id)"
)


def risk(blank: bool = False, extra: str = "", high: int = 10, medium: int = 4, many: int = 5) -> str:
    """CTE r: one row per document with risk and formatted counts."""
    bad = "regexp_full_match(text, " + lit(WS + "*") + ")" if blank else "false"
    return (
        f"r as (select *, case when bad then 'Unknown' when hits is not null or score > {high} or items > {many} then 'High' "
        f"when score >= {medium} then 'Medium' else 'Low' end as risk_level, "
        "case when hits is not null then 'Critical sensitive category detected: ' || hits || '.' "
        f"when score > {high} then 'Weighted risk score ' || score || ' exceeds {high}.' "
        f"when items > {many} then 'Detected ' || items || ' sensitive items, above the threshold of {many}.' "
        f"when score >= {medium} then 'Weighted risk score ' || score || ' is in the medium range.' "
        "else 'Few or no sensitive identifiers were detected.' end as risk_reason from "
        f"(select d.doc_id, d.body, d.tail, d.text{extra}, {bad} as bad, coalesce(items, 0) as items, "
        "coalesce(score, 0) as score, coalesce(lines, 'None') as counts_text, names, "
        "'{' || coalesce(json, '') || '}' as counts_json, hits from d left join lists using (doc_id)))"
    )


def with_(*ctes: str) -> str:
    return "with " + ", ".join(ctes) + " "


R_PLAIN = (PLAIN, F_ALL, DIM_SQL, CNT, LISTS, risk())
R_MIXED = (MIXED, F_ALL, DIM_SQL, CNT, LISTS, risk())
R_MIXED_LANG = (MIXED_LANG, F_ALL, DIM_SQL, CNT, LISTS, risk(extra=", d.lang"))
# Documents as text files, conversations as files of pages; some have no pages.
PAGED = (
    f"d as (select 'doc-' || doc_id || '.txt' as doc_id, text as body, {duck(C.mixed_suffix())} as tail, body || tail as text, false as nopages "
    "from documents union all "
    f"select 'scan ' || conv_id || '.pdf', coalesce(whole, ''), '', coalesce(whole, ''), conv_id % 9 = 0 from (select conv_id, "
    f"string_agg(s, {NL} || {NL} order by turn) filter (s <> '' and conv_id % 9 <> 0) as whole from "
    f"(select conv_id, turn, regexp_replace(text, {lit(f'^{WS}+|{WS}+$')}, '', 'g') as s from conversations) group by conv_id))"
)
R_PAGES = (PAGED, F_ALL, DIM_SQL, CNT, LISTS, risk(blank=True, extra=", d.nopages"))
R_BLANKS = (BLANKS, F_ALL, DIM_SQL, CNT, LISTS, risk(blank=True, extra=", d.lang"))
STATUS = "case when bad then 'Failure: The uploaded document does not contain readable text.' else 'Success' end"
RISK_COLUMNS = "doc_id, items as total_findings, risk_level, score as risk_score, risk_reason"

# Masked text: where findings of these corpora overlap they share one span and one mask,
# so values can be replaced one by one, in the body and in the suffix separately.
MASKED = (
    "v as (select doc_id, list(struct_pack(value := value, mask := "
    f"{MASKED_VALUE}) order by start, category) filter (start < length(body)) as head, "
    f"list(struct_pack(value := value, mask := {MASKED_VALUE}) order by start, category) "
    "filter (start >= length(body)) as rest from f join d using (doc_id) group by doc_id), "
    "mt as (select doc_id, "
    "list_reduce(coalesce(head, []), lambda a, e: struct_pack(value := replace(a.value, e.value, e.mask), mask := ''), "
    "struct_pack(value := body, mask := '')).value || "
    "list_reduce(coalesce(rest, []), lambda a, e: struct_pack(value := replace(a.value, e.value, e.mask), mask := ''), "
    "struct_pack(value := tail, mask := '')).value as masked from d left join v using (doc_id))"
)
# Findings that overlap: each is replaced at its own offsets in the text as the ones to its right have left it.
OVERLAPS = docs(duck(C.overlap_suffix()))
SPACED_CARD = "[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}"
OVERLAP_SPANS = (
    f"f as ({EMAIL_SPANS} union all {CARD_SPANS} union all {spans('text', 'Aadhaar', AADHAAR, 1)} union all "
    f"select f.doc_id, category, value, (start + length(body))::int as start from ({spans('tail', 'Credit Card', SPACED_CARD)}) f join d using (doc_id) "
    f"where {luhn("replace(value, ' ', '')")})"
)
MASKED_IN_TURN = (
    f"v as (select doc_id, list(struct_pack(at := start, over := start + length(value), put := {MASKED_VALUE}) order by start desc, category) as fs "
    "from f group by doc_id), mt as (select doc_id, list_reduce(coalesce(list_transform(fs, lambda x: struct_pack(t := x.put, at := x.at, over := x.over)), []), "
    "lambda acc, x: struct_pack(t := left(acc.t, x.at) || x.t || substr(acc.t, x.over + 1), at := 0, over := 0), "
    "struct_pack(t := text, at := 0, over := 0)).t as masked from d left join v using (doc_id))"
)
MASKED_OUT = "select doc_id, md5(masked) as masked_md5, length(masked) as masked_length from mt"


def compact(text: str) -> str:
    return f"trim(regexp_replace({text}, {lit(WS + '+')}, ' ', 'g'))"


SUMMARY = fill(N.SUMMARY_TEMPLATE, "risk_level", "score", "counts_text", "risk_reason")
TOTAL_LINE = fill(N.OBSERVATION_TOTAL, "items", f"coalesce(names, {lit(N.NO_CATEGORIES)})")
OBSERVATIONS = [
    fill(N.OBSERVATION_LEVEL, "risk_level", "score"),
    TOTAL_LINE,
    fill(N.OBSERVATION_COUNTS, "counts_text", lit(N.CONTEXT_NONE)),
]
RISKS = [fill(N.RISK_DRIVER, "risk_reason"), lit(N.RISK_UNMASKED), "left(risk_reason, 360)"]
REMEDIATION = [lit(s) for s in N.REMEDIATION]


def lines(items: list[str], bullet: str = "") -> str:
    return "(" + f" || {NL} || ".join(f"'{bullet}' || {i}" for i in items) + ")"


REPORT = f" || {NL} || ".join([
    lit(N.REPORT_TITLE), "''", "'Filename: doc ' || doc_id || '.txt'", "'Risk Level: ' || risk_level",
    "'Score: ' || score", "'Total Findings: ' || items", "'Risk Reason: ' || risk_reason", "''",
    lit(N.HEAD_COUNTS), "counts_text", "''", lit(N.HEAD_OBSERVATIONS), lines(OBSERVATIONS, "- "), "''",
    lit(N.HEAD_RISKS), lines(RISKS, "- "), "''", lit(N.HEAD_REMEDIATION), lines(REMEDIATION, "- "),
])


def truncate(text: str, limit: int) -> str:
    return f"case when length({text}) > {limit} then left({text}, {limit}) || {lit(T.TRUNCATION_MARK)} else {text} end"


CLIPPED = f"({truncate('masked', 12000)})"

# Questions.
TURNS = (
    "t as (select conv_id * 1000 + turn as q_id, conv_id as doc_id, turn, text as question "
    "from conversations where role = 'user')"
)
PICK = "((doc_id + turn) % 9)"
ROUTED = (
    f"{TURNS}, q as (select q_id, case when {PICK} = 8 then -doc_id - 1 else doc_id end as doc_id, "
    f"case when {PICK} = 6 then ' ' || chr(10) || ' ' when {PICK} = 5 then {lit(C.OPENINGS[5])} "
    + " ".join(f"when {PICK} = {i} then {lit(C.OPENINGS[i])} || question" for i in range(5))
    + " else question end as question from t)"
)
ROUTE = "case " + " ".join(
    "when " + " or ".join(f"contains(lower(question), '{w}')" for w in words) + f" then '{name}'"
    for name, words in Q.ROUTES
) + " end"
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TERMS = (
    f"list_distinct(list_filter(regexp_extract_all(lower(question), {lit(T.TERM_PATTERN)}), "
    f"lambda w: length(w) > 2 and w not in ({STOP})))"
)


def sentence_list(text: str) -> str:
    broken = f"regexp_replace({text}, {lit('([.!?])' + WS + '+')}, {lit(chr(92) + '1')} || chr(10), 'g')"
    return f"string_split_regex({broken}, {lit(chr(92) + 'n+')})"


# Best sentences of the whole corpus, by comparing every question with every sentence.
CORPUS_SENTENCES = (
    f"terms as (select q_id, {TERMS} as terms from t), "
    f"sents as (select doc_id, unnest(ss) as raw, unnest(range(len(ss))) as pos from (select doc_id, {sentence_list('masked')} as ss from mt)), "
    f"flat as (select doc_id, pos, s, lower(s) as low from (select doc_id, pos, {compact('raw')} as s from sents) where s <> ''), "
    "hit as (select q_id, doc_id, pos, left(s, 600) as sentence, len(list_filter(terms, lambda w: contains(low, w)))::int as score "
    "from terms cross join flat), "
    "best as (select q_id, (row_number() over (partition by q_id order by score desc, doc_id, pos))::int as rank, score, doc_id, "
    "sentence from hit where score > 0 qualify rank <= 4)"
)


def best_sentences(questions: str) -> str:
    """CTE best(q_id, rank, score, sentence)."""
    return (
        f"terms as (select q_id, doc_id, {TERMS} as terms from {questions}), "
        f"sents as (select doc_id, unnest(ss) as raw, unnest(range(len(ss))) as pos from "
        f"(select doc_id, {sentence_list('masked')} as ss from mt where doc_id in (select doc_id from {questions}))), "
        f"flat as (select doc_id, pos, {compact('raw')} as s from sents), "
        "hit as (select q_id, pos, left(s, 600) as sentence, "
        "len(list_filter(terms, lambda w: contains(lower(s), w)))::int as score from terms join flat using (doc_id) "
        "where s <> ''), "
        "best as (select q_id, (row_number() over (partition by q_id order by score desc, pos))::int as rank, score, "
        "sentence from hit where score > 0 qualify rank <= 4)"
    )


ANSWERS = {
    "risk": fill(Q.ANSWER_RISK, "risk_level", "score", "items", lines(RISKS, "- ")),
    "findings": fill(Q.ANSWER_FINDINGS, "items", "counts_text"),
    "summary": fill(Q.ANSWER_SUMMARY, "risk_level", "items", "coalesce(names, 'none')", f"left({compact('masked')}, 900)"),
    "remediation": fill(Q.ANSWER_REMEDIATION, lines(REMEDIATION, "- ")),
    "sentences": fill(Q.ANSWER_SENTENCES, "bullets"),
    "default": fill(Q.ANSWER_DEFAULT, "items", "risk_level", "score"),
    "blank": lit(Q.ANSWER_BLANK),
    "no_document": lit(Q.ANSWER_NO_DOCUMENT),
}
QUESTION_PARTS = (
    with_(*R_MIXED, MASKED, ROUTED, best_sentences("q"),
          f"tops as (select q_id, count(*) as n, string_agg('- ' || sentence, {NL} order by rank) as bullets, "
          f"string_agg(sentence, {NL} order by rank) as joined from best group by q_id)",
          f"a as (select q.q_id, q.question, r.*, mt.masked, tops.n as n_best, tops.bullets, tops.joined, "
          f"case when {compact('question')} = '' then 'blank' when r.doc_id is null then 'no_document' "
          f"else coalesce({ROUTE}, case when tops.n > 0 then 'sentences' else 'default' end) end as route "
          "from q left join r on r.doc_id = q.doc_id left join mt on mt.doc_id = q.doc_id "
          "left join tops on tops.q_id = q.q_id)").rstrip()
)
QUESTION_ANSWERS = (
    QUESTION_PARTS
    + " select q_id, route, case route " + " ".join(f"when '{k}' then {v}" for k, v in ANSWERS.items())
    + " end as answer, (case route when 'sentences' then n_best when 'blank' then 0 when 'no_document' then 0 else 1 end)::int "
    "as n_sources, md5(case route when 'sentences' then joined when 'blank' then '' when 'no_document' then '' "
    "else left(masked, 1600) end) as sources_md5 from a"
)

# Vectors.
VECTORS = (
    "e as (select label as doc_id, vec_id, embedding from embeddings), "
    "m as (select doc_id, dim, avg(x::double) as m from (select doc_id, unnest(embedding) as x, "
    "unnest(range(len(embedding))) as dim from e) group by all), "
    "qv as (select doc_id, list(m order by dim) as q from m group by doc_id), "
    "near as (select doc_id::bigint as q_id, vec_id, list_sum(list_transform(range(1, len(q) + 1), "
    "lambda i: (embedding[i]::double - q[i]) * (embedding[i]::double - q[i]))) as distance from e join qv using (doc_id)), "
    "top as (select q_id, (row_number() over (partition by q_id order by distance, vec_id))::int as rank, vec_id, distance "
    "from near qualify rank <= 4)"
)
CONTEXTS = (
    f"{VECTORS}, {PLAIN}, {F_ALL}, {MASKED}, "
    f"ctx as (select q_id, string_agg(masked, {NL} || {NL} order by rank) as context, count(*)::int as n_sources "
    "from top join mt on mt.doc_id = top.vec_id group by q_id)"
)

# The assistant's turn after a question is its answer, where the question's document has vectors.
ANSWERS_WITH_FALLBACK = (
    QUESTION_PARTS + f", {VECTORS}, "
    "ctx as (select q_id as doc_id, count(*)::int as n from top join documents on documents.doc_id = top.vec_id group by q_id), "
    "reply as (select conv_id * 1000 + turn - 1 as q_id, text as answer from conversations "
    f"where role = 'assistant' and {compact('text')} <> ''), "
    "b as (select a.*, q.doc_id as asked, ctx.n as n_ctx, reply.answer as reply from a join q using (q_id) left join ctx on ctx.doc_id = q.doc_id "
    "left join reply on reply.q_id = a.q_id), "
    "c as (select *, route <> 'blank' and n_ctx is not null and reply is not null as good from b) "
    "select q_id, case when good then 'retrieval' else 'fallback' end as provenance, case when good then 'chunks' else route end as route, "
    "md5(case when good then reply else case route " + " ".join(f"when '{k}' then {v}" for k, v in ANSWERS.items()) + " end end) as answer_md5, "
    "(case when good then n_ctx else case route when 'sentences' then n_best when 'blank' then 0 when 'no_document' then 0 else 1 end end)::int "
    "as n_sources from c"
)

STEP, SIZE = 850, 1000


def piece_list(text: str, limit: int = SIZE) -> str:
    """Pieces of a text: paragraphs, else sentences, else words, else runs of characters."""
    ends = (r"\n{2,}", f"[.!?]{WS}+|\\n+", f"{WS}+")

    def cut(k: int, of: str) -> str:
        if k == len(ends):
            return f"regexp_extract_all({of}, '(?s).{{1,{limit}}}')"
        found = f"regexp_extract_all({of}, {lit('(?s).+?(?:' + ends[k] + '|' + chr(92) + 'z)')})"
        return f"flatten(list_transform({found}, lambda p{k}: case when length(p{k}) <= {limit} then [p{k}] else {cut(k + 1, f'p{k}')} end))"

    return cut(0, text)


# Chunks of whole pieces, one piece after the other.
CHUNKS_PACKED = (
    with_(PLAIN, F_ALL, MASKED).replace("with ", "with recursive ", 1).rstrip()
    + f", pieces as (select doc_id, {piece_list('masked')} as ps from mt where not regexp_full_match(masked, {lit(WS + '*')})), "
    "sized as (select doc_id, ps, list_transform(ps, lambda p: length(p)) as ls, len(ps) as n from pieces), "
    "p as (select *, list_transform(range(0, n + 1), lambda i: coalesce(list_sum(ls[1:i]), 0)) as ends from sized), "
    "walk as (select doc_id, 0::bigint as i, 0::bigint as lo, null::bigint as a, null::bigint as b from p union all "
    "select doc_id, i + 1, case when full_ then next_ else lo end, case when full_ then lo end, case when full_ then i end from ("
    f"select walk.doc_id, i, lo, ends[i + 2] - ends[lo + 1] > {SIZE} as full_, "
    f"list_filter(range(lo, i + 1), lambda f: ends[i + 1] - ends[f + 1] <= 150 and ends[i + 2] - ends[f + 1] <= {SIZE})[1] as next_ "
    "from walk join p using (doc_id) where i < n)), "
    "cuts as (select doc_id, a, b from walk where a is not null union all "
    "select walk.doc_id, lo, n from walk join p using (doc_id) where i = n), "
    "c as (select doc_id, ends[a + 1]::int as start, array_to_string(ps[a + 1:b], '') as chunk from cuts join p using (doc_id)) "
    f"select doc_id, start, length(chunk) as chars, md5(chunk) as chunk_md5 from c where not regexp_full_match(chunk, {lit(WS + '*')})"
)

CHUNKS = (
    with_(PLAIN, F_ALL, MASKED).rstrip()
    + f", c as (select doc_id, masked, unnest(range(case when length(masked) <= {SIZE} then 1 "
    f"else ceil((length(masked) - 150) / {STEP})::bigint end)) as i from mt "
    f"where not regexp_full_match(masked, {lit(WS + '*')})) "
    f"select doc_id, i::int as chunk_no, (i * {STEP})::int as start, length(substr(masked, i * {STEP} + 1, {SIZE})) as chars, "
    f"md5(substr(masked, i * {STEP} + 1, {SIZE})) as chunk_md5 from c"
)

CUSTOMER_MAIL = "'user' || c_custkey || '@mail.example'"
CUSTOMER_PHONE = "'+91 ' || " + duck(C.phone_number("c_custkey"))
CUSTOMER_PAN = "'ABCDE' || " + duck(C.padded("c_custkey", 4)) + " || 'F'"
TABLE_ROWS = (
    "d as (select c_custkey as doc_id, '' as body, concat_ws(',', c_custkey, c_name, c_nationkey, c_acctbal, "
    f"c_mktsegment, {CUSTOMER_PHONE}, {CUSTOMER_PAN}, {CUSTOMER_MAIL}) as tail, tail as text from customer)"
)

BREAKDOWN = (
    "select {keys}category, label, sum(n)::bigint as occurrences, severity from {source} join dim using (category) "
    "group by {keys}category, label, severity"
)

US_PHONE = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
TOKEN = 'token = "([^"]+)"'

EXTENSION_NAME = (
    "url || case page_id % 7 when 0 then '/a.pdf' when 1 then '/B.TXT' when 2 then '/c.csv' when 3 then '/d.docx' "
    "when 4 then '/.pdf' when 5 then '/e.tar.gz' else '' end"
)

ORACLE: dict[str, str] = {
    "findings_email": with_(PLAIN) + f"select {FINDING} from ({EMAIL_SPANS})",
    "findings_credit_card": with_(PLAIN) + f"select {FINDING} from ({CARD_SPANS})",
    "findings_all": with_(AUGMENTED, F_ALL) + f"select {FINDING} from f",
    "findings_sheet_all": with_(MIXED, F_ALL)
    + f"select doc_id, category as \"Category\", value as \"Value\", {MASKED_VALUE} as \"Masked Value\", "
    "start as \"Start\", (start + length(value))::int as \"End\", 'High' as \"Confidence\" from f",
    "findings_pages": with_("d as (select page_id as doc_id, html as text, html as body, '' as tail from pages)", F_ALL)
    + f"select {FINDING} from f",
    "luhn_candidates": f"select doc_id, v as value, {luhn('v')} as is_card from "
    f"(select doc_id, unnest(regexp_extract_all(text, '{CARD}')) as v from documents)",
    "custom_rules": with_(
        PLAIN, F_ALL,
        f"g as (select category, count(*) as n from f group by all union all "
        f"select 'US Phone', sum(len(regexp_extract_all(text, {lit(US_PHONE)}))) from d union all "
        f"select 'Quoted Token', sum(len(regexp_extract_all(text, {lit(TOKEN)}))) from d)", DIM_SQL)
    + "select category, coalesce(label, category) as label, n::bigint as occurrences, "
    "coalesce(severity, 'Standard') as severity from g left join dim using (category) where n > 0",
    "findings_none_selected": with_(MIXED, F_ALL) + "select doc_id, category, value from f",
    "findings_filtered": with_(AUGMENTED, F_ALL)
    + f"select doc_id, category, {MASKED_VALUE} as masked_value from f where category in ('PAN', 'Password')",
    "findings_selected": with_(MIXED, F_ALL, DIM_SQL)
    + "select doc_id, category, value from f where category in (select category from dim where severity = 'Critical')",
    "distinct_category_list": with_(AUGMENTED, F_ALL) + "select distinct category from f",
    "masked_values": "select c_custkey, category, " + mask("category", "value") + " as masked_value from "
    "(select c_custkey, c_mktsegment || '.' || c_custkey || '@mail' || c_nationkey || '.example' as value, "
    "unnest([" + ", ".join(f"'{c}'" for c in STYLE) + "]) as category from customer)",
    "masked_text": with_(PLAIN, F_ALL, MASKED) + MASKED_OUT,
    "masked_text_augmented": with_(AUGMENTED, F_ALL, MASKED) + MASKED_OUT,
    "masked_overlaps": with_(OVERLAPS, OVERLAP_SPANS, MASKED_IN_TURN) + MASKED_OUT,
    "doc_category_counts": with_(MIXED, F_ALL, CNT) + "select * from cnt",
    "corpus_category_breakdown": with_(AUGMENTED, F_ALL, DIM_SQL, CNT) + BREAKDOWN.format(keys="", source="cnt"),
    "breakdown_zero_counts": with_(MIXED, F_ALL, DIM_SQL, CNT) + BREAKDOWN.format(keys="doc_id, ", source="cnt"),
    "doc_category_breakdown": with_(MIXED, F_ALL, DIM_SQL, CNT) + BREAKDOWN.format(keys="doc_id, ", source="cnt"),
    "lang_category_breakdown": with_(MIXED_LANG, F_ALL, DIM_SQL, CNT)
    + BREAKDOWN.format(keys="lang, ", source="cnt join d using (doc_id)"),
    "doc_risk": with_(*R_PLAIN) + f"select {RISK_COLUMNS} from r",
    "doc_risk_mixed": with_(*R_MIXED) + f"select {RISK_COLUMNS} from r",
    "risk_from_findings": with_(*R_MIXED) + f"select {RISK_COLUMNS} from r",
    "risk_mix": with_(*R_PLAIN)
    + "select risk_level, count(*) as documents, sum(score)::bigint as total_score, max(score) as max_score from r group by 1",
    "risk_mix_mixed": with_(*R_MIXED_LANG)
    + "select lang, risk_level, count(*) as documents, sum(score)::bigint as total_score, max(score) as max_score from r group by all",
    "severity_labels": with_(AUGMENTED, F_ALL, DIM_SQL)
    + "select doc_id, category, start, label, severity, weight, critical from f join dim using (category)",
    "risk_theme": with_(*R_BLANKS)
    + "select doc_id, risk_level, case risk_level when 'Low' then 'Low Threat' when 'Medium' then 'Medium Threat' "
    "when 'High' then 'High Threat' else 'Unclassified' end as level_label, case risk_level when 'Low' then 'Emerald' "
    "when 'Medium' then 'Amber' when 'High' then 'Crimson' else 'Slate' end as tone from r",
    "counts_formats": with_(*R_MIXED) + "select doc_id, counts_text, counts_json from r",
    "fallback_summary": with_(*R_MIXED) + f"select doc_id, {SUMMARY} as summary from r",
    "playbook": with_(*R_MIXED)
    + f"select doc_id, {lines(OBSERVATIONS)} as observations, {lines(RISKS)} as risks, {lines(REMEDIATION)} as remediation from r",
    "playbook_with_model_texts": with_(
        *R_MIXED,
        "x as (select *, case when doc_id % 3 = 0 then 'Intro. SECURITY  RISKS: ' || text "
        f"when doc_id % 3 = 1 then 'Intro. Security' || {NL} || 'Risks: ' || text || ' suggested remediation: none' else text end as s, "
        f"case when doc_id % 2 = 0 then text else 'Trade Secret:' || {NL} || ' None  identified ' || doc_id end as ctx from r)",
        f"y as (select *, {compact('s')} as cs, {compact('ctx')} as cc from x)",
        "z as (select *, trim(regexp_extract(cs, '(?i)Security Risks:\\s*(.+?)(?:Suggested Remediation:|$)', 1)) as section, "
        f"case when cc = '' or (contains(cc, 'None identified') and length(cc) < 180) then {lit(N.CONTEXT_NONE)} "
        f"else {fill(N.CONTEXT_NOTED, 'left(cc, 260)')} end as noted from y)")
    + f"select doc_id, case when section <> '' then left(section, 360) else {lit(N.ADVISORY)} end as summary_risk, "
    f"md5({fill(N.OBSERVATION_COUNTS, 'counts_text', 'noted')}) as context_md5 from z",
    "report": with_(*R_MIXED)
    + f"select doc_id, 'compliance_playbook_doc_' || doc_id || '.txt.txt' as report_file, {REPORT} as report from r",
    "prompt_requests": with_(
        *R_PLAIN, MASKED,
        f"p as (select doc_id, 'summary' as kind, "
        f"{fill(N.SUMMARY_PROMPT, 'risk_level', 'score', 'risk_reason', 'counts_text', CLIPPED)} as prompt from r join mt using (doc_id) "
        f"union all select doc_id, 'context', {fill(N.CONTEXT_PROMPT, CLIPPED)} from mt)")
    + "select doc_id, kind, md5(prompt) as prompt_md5, length(prompt) as prompt_length from p",
    "compact_text": f"select doc_id, md5({compact('text')}) as compact_md5, length({truncate('text', 1000)}) as clipped_length from documents",
    "safe_names": "select page_id, trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '_') as safe_name from pages",
    "extension_check": (
        f"with n as (select page_id, lower(regexp_extract({EXTENSION_NAME}, '^.*/[^/]+(\\.[^./]+)/*$', 1)) as raw, "
        f"regexp_extract(regexp_replace({EXTENSION_NAME}, '/+$', ''), '([^/]*)$', 1) as name, length(html) * 8000 as size from pages), "
        "x as (select page_id, size, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) as extension from n) "
        "select page_id, extension, case when extension not in ('.pdf', '.txt', '.csv') then "
        "'Unsupported file type. Allowed types: .pdf, .txt, .csv.' when size > 20 * 1024 * 1024 then "
        "'File is too large. Maximum size is 20 MB.' end as error from x"
    ),
    "decode_bytes": "select doc_id, md5(case when doc_id % 2 = 0 then text else "
    f"regexp_replace(text, {lit('[^' + chr(92) + 'x00-' + chr(92) + 'xff]')}, '?', 'g') end) as text_md5 from documents",
    "content_hash_dedupe": "select sha256(text) as content_hash, min(doc_id) as doc_id, count(*) as copies from documents group by 1",
    "first_copy_documents": "select doc_id, length(text) as chars from documents "
    "where doc_id in (select min(doc_id) from documents group by text)",
    "first_copy_texts": "select doc_id, lang, md5(text) as text_md5 from documents "
    "where doc_id in (select min(doc_id) from documents group by text)",
    "blank_check": with_(*R_BLANKS)
    + f"select doc_id, {STATUS} as status, risk_level, score as risk_score from r where bad",
    "audit_log": with_(*R_BLANKS)
    + "select 'doc-' || doc_id || '.txt' as filename, risk_level, score::varchar as risk_score, "
    f"counts_json as detection_counts, {STATUS} as status from r",
    "audit_summary": with_(*R_BLANKS)
    + "select lang, count(*) as scans, count(*) filter (bad) as failures, count(*) filter (risk_level = 'High') as high, "
    "count(*) filter (risk_level = 'Medium') as medium, count(*) filter (risk_level = 'Low') as low, "
    "round(avg(score), 6) as mean_score from r group by lang",
    "audit_round_trip": with_(*R_BLANKS)
    + f"select risk_level, {STATUS} as status, count(*) as scans, sum(score)::bigint as total_score, "
    "sum(items)::bigint as findings from r group by all",
    "page_assembly": (
        f"with p as (select conv_id, turn, regexp_replace(text, {lit(f'^{WS}+|{WS}+$')}, '', 'g') as s from conversations), "
        f"g as (select conv_id as doc_id, count(*) filter (s <> '')::int as pages, "
        f"coalesce(string_agg(s, {NL} || {NL} order by turn) filter (s <> ''), '') as text from p group by 1) "
        "select doc_id, pages, md5(text) as text_md5, length(text) as text_length from g"
    ),
    "table_row_scan": with_(TABLE_ROWS, F_ALL)
    + f"select doc_id as c_custkey, category, value, {MASKED_VALUE} as masked_value, start, (start + length(value))::int as \"end\" from f",
    "file_scan": with_(MIXED, F_ALL)
    + "select '.txt' as extension, category, count(*) as n from f group by all union all "
    "select '.csv', 'Phone', count(*) from customer union all "
    "select '.json', 'Unsupported file type. Allowed types: .pdf, .txt, .csv.', 0",
    "incremental_files": with_(MIXED, F_ALL)
    + "select '.txt' as extension, category, count(*) as n from f group by all union all "
    "select '.csv', 'Phone', count(*) from customer",
    "report_table": with_(*R_MIXED)
    + f"select 'compliance_playbook_doc_' || doc_id || '.txt.txt' as report_file, md5({REPORT}) as report_md5 from r",
    "incremental_scan": with_(*R_PLAIN)
    + f"select doc_id, risk_level, score as risk_score, {STATUS} as status from r "
    "where doc_id in (select min(doc_id) from documents group by text)",
    "chunks": CHUNKS,
    "chunks_blank": (
        "with n as (select doc_id, length(text) as k from documents "
        f"where not regexp_full_match(text, {lit(WS + '*')})), "
        f"c as (select doc_id, k, unnest(range(case when k <= {SIZE} then 1 else ceil((k - 150) / {STEP})::bigint end)) as i from n) "
        f"select doc_id, count(*) as n, sum(least({SIZE}, k - i * {STEP}))::bigint as chars from c group by doc_id"
    ),
    "constant_context": with_(MIXED) + f"select doc_id, {lit(N.NO_CONTEXT)} as context from d",
    "vector_topk": with_(VECTORS) + "select q_id, rank, vec_id, round(distance, 5) as distance from top",
    "vector_context": with_(CONTEXTS) + "select q_id, md5(context) as context_md5, n_sources from ctx",
    "vector_requests": with_(
        CONTEXTS,
        "p as (select q_id, " + fill(N.QUESTION_PROMPT, "context", "('Which topics does collection ' || q_id || ' cover?')")
        + " as prompt from ctx)")
    + "select q_id, 'question' as kind, md5(prompt) as prompt_md5, length(prompt) as prompt_length from p",
    "question_terms": with_(TURNS) + f"select q_id, array_to_string(list_sort({TERMS}), ' ') as terms from t",
    "sentence_split": (
        f"with s as (select doc_id, unnest({sentence_list('text')}) as raw from documents), "
        f"c as (select doc_id, {compact('raw')} as s from s) "
        "select doc_id, count(*) as n, sum(length(s))::bigint as chars from c where s <> '' group by doc_id"
    ),
    "question_route": with_(ROUTED) + f"select q_id, coalesce({ROUTE}, 'text') as route from q",
    "relevant_sentence_rank": with_(PLAIN, F_ALL, MASKED, TURNS, best_sentences("t"))
    + "select q_id, rank, score, sentence from best",
    "question_answers": QUESTION_ANSWERS,
    "answers_with_fallback": ANSWERS_WITH_FALLBACK,
    "chunks_packed": CHUNKS_PACKED,
    "corpus_sentences": with_(PLAIN, F_ALL, MASKED, TURNS, CORPUS_SENTENCES) + "select q_id, rank, score, doc_id, sentence from best",
    "audit_times": (
        "select lang, count(*) as scans, round(avg(t), 6) as mean_time, round(median(t), 6) as median_time "
        "from (select lang, case when doc_id % 10 < 9 then n_chars * 0.001::double end as t from documents) group by lang"
    ),
    "audit_append": with_(*R_BLANKS)
    + "select case when score = 0 then 'first' else 'second' end as run, risk_level, count(*) as scans, "
    "sum(score)::bigint as total_score, sum(items)::bigint as findings from r group by all",
    "pages_scan": with_(*R_PAGES)
    + f"select doc_id as filename, items as total_findings, risk_level, score as risk_score, case when nopages then {lit('Failure: ' + PDF_MESSAGE)} "
    f"else {STATUS} end as status from r",
    "counts_table": with_(MIXED, F_ALL, CNT)
    + "select doc_id, (row_number() over (partition by doc_id order by category))::int as place, category, n from cnt",
    "options_risk": with_(MIXED, F_ALL, DIM_SQL, CNT, LISTS, risk(high=7, medium=2, many=2)) + f"select {RISK_COLUMNS} from r",
    "options_chunks": (
        "with c as (select doc_id, text, unnest(range(case when length(text) <= 300 then 1 else ceil((length(text) - 40) / 260)::bigint end)) as i "
        f"from documents where not regexp_full_match(text, {lit(WS + '*')})) "
        "select doc_id, i::int as chunk_no, (i * 260)::int as start, length(substr(text, i * 260 + 1, 300)) as chars, "
        "md5(substr(text, i * 260 + 1, 300)) as chunk_md5 from c"
    ),
    "incremental_batches": with_(*R_MIXED)
    + "select items as total_findings, risk_level, score as risk_score, count(distinct text) as contents from r group by all",
}
ORACLE["custom_rules_table"] = ORACLE["custom_rules"]
