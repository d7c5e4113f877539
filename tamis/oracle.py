"""DuckDB twins of the queries. The rules' patterns are RE2 and go into the SQL as they are; everything else is said once
more in SQL: byte offsets by running sums, checksums by list functions, profiles by conditional aggregates."""

from __future__ import annotations

from .functions import validators as v
from .plans.default_rules import DEFAULT_RULES
from .plans.rules import Detector, Node, RuleSet

MATCHES = 64


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _at(d: str, i: str | int, n: int = 1) -> str:
    return f"TRY_CAST(substr({d}, {i}, {n}) AS BIGINT)"


def _sum(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def _weighted(d: str, weights, start: int = 1) -> str:
    return _sum([f"({_at(d, start + i)} * {w})" for i, w in enumerate(weights)])


def _luhn(d: str) -> str:
    double = lambda i: f"TRY_CAST(substr(reverse({d}), {i}, 1) AS INTEGER)"
    part = f"CASE WHEN i % 2 = 1 THEN {double('i')} ELSE {double('i')} * 2 - CASE WHEN {double('i')} > 4 THEN 9 ELSE 0 END END"
    return f"(list_sum(list_transform(range(1, length({d}) + 1), lambda i: {part})) % 10 = 0)"


def _within(n: str, ranges) -> str:
    return "(" + " OR ".join(f"{n} BETWEEN {a} AND {b}" for a, b in ranges) + ")"


def _iban(x: str) -> str:
    t = f"upper(replace({x}, ' ', ''))"
    value = lambda c: f"CASE WHEN {c} BETWEEN '0' AND '9' THEN (a * 10 + ascii({c}) - 48) % 97 ELSE (a * 100 + ascii({c}) - 55) % 97 END"
    turned = f"substr({t}, 5) || substr({t}, 1, 4)"
    char = f"substr({turned}, i::INTEGER, 1)"
    rest = f"list_reduce(list_prepend(0::BIGINT, range(1, length({t}) + 1)), lambda a, i: {value(char)})"
    lengths = " ".join(f"WHEN {q(c)} THEN {n}" for c, n in v.IBAN_LENGTHS.items())
    return f"(regexp_full_match({t}, '[0-9A-Z]{{15,34}}') AND length({t}) = CASE substr({t}, 1, 2) {lengths} ELSE length({t}) END AND {rest} = 1)"


def _vin(x: str) -> str:
    t = f"upper(trim({x}))"
    rest = f"({_weighted(f'translate({t}, {q(v.VIN_LETTERS)}, {q(v.VIN_VALUES)})', v.VIN_WEIGHTS)} % 11)"
    return f"(regexp_full_match({t}, '[A-HJ-NPR-Z0-9]{{17}}') AND substr({t}, 9, 1) = CASE WHEN {rest} = 10 THEN 'X' ELSE {rest}::VARCHAR END)"


def _de_tax(x: str) -> str:
    d = _digits(x)
    total = f"((TRY_CAST(substr({d}, i::INTEGER, 1) AS BIGINT) + p) % 10)"
    product = f"list_reduce(list_prepend(10::BIGINT, range(1, 11)), lambda p, i: CASE WHEN {total} = 0 THEN 10 ELSE {total} END * 2 % 11)"
    return f"(length({d}) = 11 AND (11 - {product}) % 10 = {_at(d, 11)})"


def _dni(x: str) -> str:
    t = f"upper(replace(trim({x}), '-', ''))"
    return f"(regexp_full_match({t}, '[0-9]{{8}}[A-Z]') AND substr({q(v.DNI_LETTERS)}, ({_at(t, 1, 8)} % 23 + 1)::INTEGER, 1) = substr({t}, 9, 1))"


def _nine(x: str, test: str) -> str:
    return f"(length({_digits(x)}) = 9 AND {test})"


def _joined_npi(x: str) -> str:
    return f"('80840' || {_digits(x)})"


VALIDATORS = {
    "luhn_check": lambda x: f"(length({_digits(x)}) >= 12 AND {_luhn(_digits(x))})",
    "sin_check": lambda x: _nine(x, _luhn(_digits(x))),
    "npi_check": lambda x: f"(length({_digits(x)}) = 10 AND {_luhn(_joined_npi(x))})",
    "iban_mod97": _iban,
    "aba_checksum": lambda x: _nine(x, f"{_weighted(_digits(x), (3, 7, 1) * 3)} % 10 = 0"),
    "vin_check": _vin,
    "ssn_check": lambda x: _nine(x, f"{_at(_digits(x), 1, 3)} NOT IN (0, 666) AND {_at(_digits(x), 1, 3)} < 900 AND {_at(_digits(x), 4, 2)} <> 0 AND {_at(_digits(x), 6, 4)} <> 0"),
    "ein_prefix": lambda x: _nine(x, _within(_at(_digits(x), 1, 2), v.EIN_PREFIXES)),
    "itin_check": lambda x: _nine(x, f"{_at(_digits(x), 1)} = 9 AND {_within(_at(_digits(x), 4, 2), v.ITIN_GROUPS)}"),
    "nir_check": lambda x: f"(length({_digits(x)}) = 15 AND 97 - {_at(_digits(x), 1, 13)} % 97 = {_at(_digits(x), 14, 2)})",
    "de_tax_check": _de_tax,
    "es_dni_check": _dni,
    "bsn_check": lambda x: _nine(x, f"{_digits(x)} <> '000000000' AND {_weighted(_digits(x), (9, 8, 7, 6, 5, 4, 3, 2, -1))} % 11 = 0"),
    "dea_check": lambda x: f"(regexp_full_match(upper(trim({x})), '[A-Z][A-Z9][0-9]{{7}}') AND {_weighted(f'upper(trim({x}))', (1, 2, 1, 2, 1, 2), 3)} % 10 = {_at(f'upper(trim({x}))', 9)})",
}


def _anywhere(column: str, words) -> str:
    return "(" + (" OR ".join(f"contains({column}, {q(w)})" for w in words) or "false") + ")"


def guard(d: Detector) -> str:
    parts = []
    if d.literals:
        parts.append(_anywhere("text", d.literals))
    if d.needs_digit:
        parts.append("(" + " OR ".join(["regexp_matches(text, '[0-9]')", *(f"contains(text, {q(w)})" for w in d.digit_or)]) + ")")
    if d.best_effort:
        parts.append(_anywhere("lower(text)", [k.lower() for k in d.keywords]))
    return " AND ".join(parts) or "true"


def _starts(between: str, sizes: str) -> str:
    """Bytes before each hit: of the texts between hits up to it, and of the hits before it."""
    before = f"list_sum(list_transform({between}[1:i], lambda s: strlen(s)))"
    return f"list_transform(range(1, len({between})), lambda i: ({before} + {sizes})::BIGINT)"


def matches(d: Detector, limit: int | None = MATCHES, table: str = "documents") -> str:
    """doc_id, text, m (matches, the first `limit` of them) of the documents with any."""
    found = f"regexp_extract_all(text, {q(d.pattern)})"
    found = f"list_slice({found}, 1, {limit})" if limit else found
    return f"(SELECT doc_id, text, {found} AS m FROM {table} WHERE {guard(d)} AND regexp_matches(text, {q(d.pattern)}))"


def starts(d: Detector, limit: int | None = MATCHES) -> str:
    hits = "coalesce(list_sum(list_transform(m[1:i - 1], lambda s: strlen(s))), 0)"
    every = _starts(f"string_split_regex(text, {q(d.pattern)})", hits)
    return f"list_slice({every}, 1, {limit})" if limit else every


def keyword_places(d: Detector) -> str:
    each = []
    for k in d.keywords:
        k = k.lower()
        places = _starts(f"string_split(lower(text), {q(k)})", f"(i - 1) * {len(k.encode())}")
        each.append(f"list_transform({places}, lambda p: {{'at': p, 'size': {len(k.encode())}}})")
    return "flatten([" + ", ".join(each) + "])" if each else "[]"


def _near(start: str, places: str, window: int) -> str:
    return f"len(list_filter({places}, lambda word: word.at >= {start} - {window} AND word.at + word.size <= {start} + {window})) > 0"


def matches_near(rules: RuleSet) -> str:
    """Every match, and whether a keyword lies within the window."""
    parts = []
    for d in rules.detectors:
        if d.kind == "regex" and d.pattern:
            near = f"list_transform({starts(d, None)}, lambda p: {_near('p', 'k', rules.confidence.keyword_window)})" if d.keywords else "list_transform(m, lambda x: false)"
            source = f"(SELECT *, {keyword_places(d) if d.keywords else '[]'} AS k FROM {matches(d, None)})"
            parts.append(f"SELECT doc_id, {q(d.id)} AS detector, unnest(range(1, len(m) + 1))::BIGINT AS ord, unnest({starts(d, None)}) AS start, unnest({near}) AS near_keyword FROM {source}")
    return "\nUNION ALL\n".join(parts)


def matches_long(rules: RuleSet, ids: list[str] | None = None) -> str:
    parts = []
    for d in rules.detectors:
        if d.kind == "regex" and d.pattern and (ids is None or d.id in ids):
            valid = " AND ".join(VALIDATORS[name]("value") for name in d.validators) or "true"
            parts.append(f"SELECT doc_id, {q(d.id)} AS detector, ord::BIGINT AS ord, start, value, coalesce({valid}, false) AS valid FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS ord, unnest({starts(d, None)}) AS start, unnest(m) AS value FROM {matches(d, None)})")
    return "\nUNION ALL\n".join(parts)


def findings_of(d: Detector, rules: RuleSet) -> str:
    c = rules.confidence
    valid = " AND ".join(VALIDATORS[name]("x") for name in d.validators)
    validated = f"len(list_filter(m, lambda x: coalesce({valid}, false)))" if valid else "len(m)"
    keyword = f"len(list_filter({starts(d)}, lambda p: {_near('p', 'k', c.keyword_window)})) > 0" if d.keywords else "false"
    places = keyword_places(d) if d.keywords else "[]"
    points = f"least(100, {d.base} + CASE WHEN keyword THEN {c.keyword_boost} ELSE 0 END + least(n - 1, {c.max_instance_boosts}) * {c.instance_boost}" + (f" + CASE WHEN good > 0 THEN {c.validator_boost} ELSE 0 END)" if d.validators else ")")
    fired = f"confidence >= {c.fire_threshold}" + (" AND good > 0" if d.validators else "") + (" AND keyword" if d.best_effort else "")
    return f"""SELECT doc_id, {q(d.id)} AS detector, n::BIGINT AS raw_count, good::BIGINT AS validated_count, keyword AS keyword_found, confidence, ({fired}) AS fired FROM (
        SELECT *, ({points})::BIGINT AS confidence FROM (
        SELECT doc_id, len(m) AS n, {validated} AS good, {keyword} AS keyword FROM (SELECT *, {places} AS k FROM {matches(d)})))"""


TOKENS = r"""tokens AS (
    SELECT doc_id, ord - 1 AS ord, token, gap, (lead_bytes + coalesce(sum(strlen(token) + strlen(gap)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, regexp_matches(token, '^\p{Lu}') AS capital
    FROM (
        SELECT doc_id, strlen(regexp_extract(text, '^[^\p{L}]*')) AS lead_bytes, unnest(range(1, len(tokens) + 1)) AS ord, unnest(tokens) AS token, unnest(gaps) AS gap
        FROM (SELECT doc_id, text, regexp_extract_all(text, '(\p{L}[\p{L}''-]*)([^\p{L}]*)', 1) AS tokens, regexp_extract_all(text, '(\p{L}[\p{L}''-]*)([^\p{L}]*)', 2) AS gaps FROM documents)
    )
)"""
RUNS = (
    TOKENS
    + r""", marked AS (
    SELECT *, CASE WHEN close THEN before END AS title_before, coalesce(close AND capital_before, false) AS joined
    FROM (SELECT *, regexp_full_match(lag(gap) OVER w, '[ \t]*') AS close, lag(token) OVER w AS before, lag(capital) OVER w AS capital_before FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
    WHERE capital
), numbered AS (
    SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM marked
), runs AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY ord) AS place FROM numbered
)"""
)


def _list(words) -> str:
    return "(" + ", ".join(q(w) for w in sorted(words)) + ")"


def spans(rules: RuleSet, evidence: str | None = None) -> str:
    """CTEs up to `spans` and `name_docs`. `evidence`: a query for the listed words in the place of the rules' own."""
    d = next(d for d in rules.detectors if d.kind == "dictionary")
    w, c = d.dictionary, rules.confidence
    return f"""{RUNS}, titled AS (
    SELECT *, lower(token) IN {f"({evidence})" if evidence else _list(w.evidence)} AS listed, first(lower(token)) OVER r IN {_list(w.titles)} AS own, coalesce(first(lower(title_before)) OVER r IN {_list(w.titles)}, false) AS ahead
    FROM runs WINDOW r AS (PARTITION BY doc_id, run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), grouped AS (
    SELECT doc_id, run, min(start) AS start, string_agg(token, ' ' ORDER BY ord) AS span, count(*) FILTER (listed) AS evidence, bool_or(own OR ahead) AS titled
    FROM titled WHERE place - CASE WHEN own THEN 1 ELSE 0 END BETWEEN 1 AND {w.max_span_tokens} GROUP BY doc_id, run
), placed AS (
    SELECT doc_id, {keyword_places(d)} AS k FROM documents
), near AS (
    SELECT g.*, {_near('g.start', 'p.k', c.keyword_window)} AS near_keyword FROM grouped g JOIN placed p USING (doc_id) WHERE evidence > 0 OR titled
), scored AS (
    SELECT *, (evidence * {w.name_hit} + CASE WHEN evidence >= 2 THEN {w.adjacency} ELSE 0 END + CASE WHEN titled THEN {w.title} ELSE 0 END + CASE WHEN near_keyword THEN {w.keyword} ELSE 0 END)::BIGINT AS score FROM near
), spans AS (
    SELECT doc_id, start, span, evidence::BIGINT AS evidence, titled, near_keyword, score, least(95, score * 8 + 40)::BIGINT AS confidence, score >= {w.fire} AS fired FROM scored
), name_docs AS (
    SELECT doc_id, {q(d.id)} AS detector, count(*)::BIGINT AS raw_count, count(*)::BIGINT AS validated_count, false AS keyword_found, max(confidence)::BIGINT AS confidence, true AS fired FROM spans WHERE fired GROUP BY doc_id
)"""


def findings(rules: RuleSet) -> str:
    """CTEs up to `findings`."""
    parts = [findings_of(d, rules) for d in rules.detectors if d.kind == "regex" and d.pattern]
    return f"WITH {spans(rules)}, findings AS (\n" + "\nUNION ALL\n".join(parts) + "\nUNION ALL SELECT * FROM name_docs)"


def _leaf(n: Node) -> str:
    return f"{n.id}_{n.min_validated}"


def _leaves(n: Node) -> set[tuple[str, str, int]]:
    return {(_leaf(n), n.id, n.min_validated)} if n.op == "detector" else set().union(*(_leaves(x) for x in n.of))


def _confidence(n: Node) -> str:
    """The node's confidence, or null if it does not hold."""
    if n.op == "detector":
        return _leaf(n)
    parts = [_confidence(x) for x in n.of]
    held = " + ".join(f"CASE WHEN ({p}) IS NULL THEN 0 ELSE 1 END" for p in parts)
    best = "greatest(" + ", ".join(f"coalesce({p}, 0)" for p in parts) + ", 0)"
    return f"CASE WHEN {held} >= {len(parts) if n.op == 'and' else n.least} THEN {best} END"


def profiles(rules: RuleSet) -> str:
    """CTEs up to `profiles`: doc_id, profile_id, verdict_on_match, confidence, severity."""
    leaves = sorted(set().union(*(_leaves(p.match) for p in rules.profiles)))
    columns = ", ".join(f"max(CASE WHEN detector = {q(i)} AND fired AND validated_count >= {n} THEN confidence END) AS {name}" for name, i, n in leaves)
    ceiling = {"BLOCK": 2, "": 2, "ESCALATE": 1}
    each = "\nUNION ALL\n".join(f"SELECT doc_id, {q(p.id)} AS profile_id, {q(p.verdict_on_match)} AS verdict_on_match, ({_confidence(p.match)})::BIGINT AS confidence, {ceiling.get(p.verdict_on_match, 0)} AS ceiling FROM flat" for p in rules.profiles)
    return f"""{findings(rules)}, flat AS (SELECT doc_id, {columns} FROM findings GROUP BY doc_id), satisfied AS ({each}),
    profiles AS (SELECT doc_id, profile_id, verdict_on_match, confidence, least(ceiling, CASE WHEN confidence >= {rules.confidence.block_threshold} THEN 2 ELSE 1 END) AS severity FROM satisfied WHERE confidence IS NOT NULL)"""


def labels(rules: RuleSet) -> str:
    each = [f"SELECT doc_id, {q(m.id)} AS marker_id, {q(s)} AS label FROM documents WHERE contains(text, {q(s)})" for m in rules.markers for s in m.distinctive]
    return " UNION ALL ".join(each)


def verdicts(rules: RuleSet) -> str:
    """CTEs up to `verdicts`: doc_id, verdict, profiles (in the order of their ids, joined)."""
    return f"""{profiles(rules)}, body AS ({labels(rules)}), severities AS (
        SELECT doc_id, severity FROM profiles UNION ALL SELECT doc_id, 1 FROM body
    ), worst AS (SELECT doc_id, max(severity) AS severity FROM severities GROUP BY doc_id),
    named AS (SELECT doc_id, string_agg(profile_id, ',' ORDER BY profile_id) AS profiles FROM profiles GROUP BY doc_id),
    verdicts AS (
        SELECT d.doc_id, d.lang, ['ALLOW', 'ESCALATE', 'BLOCK'][coalesce(w.severity, 0) + 1] AS verdict, coalesce(n.profiles, '') AS profiles, strlen(d.text)::BIGINT AS bytes_seen
        FROM documents d LEFT JOIN worst w USING (doc_id) LEFT JOIN named n USING (doc_id)
    )"""


RULES = DEFAULT_RULES
