"""DuckDB twins of the registered queries, over the same tables.

Common inputs are named CTEs; `sql(...)` puts the needed ones in front of a query.
"""

from __future__ import annotations

from ..functions import banks, html, stem
from ..functions.hashing import draw_sql
from .queries import AS_OF, SEED
from .views import URL_CASES

ORACLES: dict[str, str] = {}

STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in banks.STOP_WORDS)
W = r"\p{L}\p{N}_"
TRIM = r"'^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def arr(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {TRIM})"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[{W}]{{2,}}')"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def drop_stop(x: str) -> str:
    return rf"array_to_string(list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '' AND w NOT IN ({STOP})), ' ')"


def normalise_jobs(x: str) -> str:
    step = rf"regexp_replace(lower({x}), '\p{{Nd}}+', '', 'g')"
    step = rf"regexp_replace({step}, '\s+', ' ', 'g')"
    return drop_stop(rf"regexp_replace({step}, '[^{W}\s]', '', 'g')")


def normalise_sms(x: str) -> str:
    return drop_stop(rf"regexp_replace(lower({x}), '[^{W}\s]', '', 'g')")


def pairs(w: str, n: int) -> str:
    body = " || ' ' || ".join(f"{w}[i+{k}]" for k in range(n))
    return f"list_transform(range(1, len({w}) + 2 - {n}), lambda i: {body})"


def hits(x: str, phrases) -> str:
    return f"list_filter({arr(phrases)}, lambda k: contains(lower({x}), k))"


def band(score: str, scheme: str) -> str:
    op = "<=" if scheme == "ceiling" else ">="
    limits = banks.RISK_BANDS[scheme]
    cases = " ".join(f"WHEN {score} {op} {n} THEN {q(label)}" for n, label in limits[:-1])
    return f"CASE {cases} ELSE {q(limits[-1][1])} END"


def fraud_type(x: str, profile: str) -> str:
    signals = dict(banks.SIGNALS[profile])
    none = signals.pop("none")
    n = [f"len({hits(x, s)})" for s in signals.values()]
    best = f"greatest({', '.join(n)})"
    cases = " ".join(f"WHEN {k} = {best} THEN {q(name)}" for k, name in zip(n, signals))
    return f"CASE WHEN {best} = 0 THEN {q(none)} {cases} END"


BANK = ", ".join(f"({i}::BIGINT, {q(c)}, {co}, {q(p)}, {ko})" for i, c, co, p, ko in banks.bank_rows())
N = len(banks.phrase_list())

CTES: dict[str, tuple[list[str], str]] = {
    "bank": ([], f"SELECT * FROM (VALUES {BANK}) AS b(idx, category, cat_ord, phrase, kw_ord)"),
    "ads": (
        ["bank"],
        f"""SELECT d.doc_id,
            CASE WHEN d.doc_id % 5 < 3 THEN d.text || ' ' || b1.phrase || '. ' || upper(b2.phrase) || '. ' ||
              CASE d.doc_id % 4 WHEN 0 THEN 'job' WHEN 1 THEN 'loan' WHEN 2 THEN 'invest trading' ELSE '' END
              ELSE d.text END AS text,
            CAST(CASE WHEN d.doc_id % 5 < 3 THEN 1 ELSE 0 END AS INTEGER) AS label,
            CAST(d.doc_id % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS p
            FROM documents d JOIN bank b1 ON b1.idx = d.doc_id % {N} JOIN bank b2 ON b2.idx = (d.doc_id * 7 + 3) % {N}""",
    ),
    "reports": (
        ["bank"],
        f"""SELECT 'R-' || upper(substr(md5(CAST(e.event_id AS VARCHAR)), 1, 8)) AS report_id, e.event_id,
            e.ts AS received_at, CAST(e.user_id AS VARCHAR) AS client, p.url,
            'user-' || CAST(e.user_id AS VARCHAR) AS reporter_name,
            CAST(least(floor(e.value), 100) AS INTEGER) AS risk_score,
            CASE e.event_id % 4 WHEN 0 THEN 'Job / Employment Fraud' WHEN 1 THEN 'Financial Loan Scam'
              WHEN 2 THEN 'Investment / Ponzi Scheme' ELSE 'General / Unknown Fraud' END AS fraud_category,
            CASE WHEN e.event_type = 'error' THEN 'REVIEWED' ELSE 'FILED' END AS status,
            b1.phrase || ' ' || b2.phrase AS evidence_text, 'seen in a forwarded message' AS comment
            FROM events e CROSS JOIN (SELECT count(*) AS n FROM pages) c JOIN pages p ON p.page_id = e.event_id % c.n
            JOIN bank b1 ON b1.idx = e.event_id % {N} JOIN bank b2 ON b2.idx = (e.event_id * 11 + 5) % {N}""",
    ),
    "report_hits": (
        ["reports", "bank"],
        "SELECT r.report_id, r.event_id, count(b.idx) AS hits FROM reports r LEFT JOIN bank b "
        "ON contains(lower(r.evidence_text), b.phrase) GROUP BY ALL",
    ),
    "url_cases": (
        [],
        "SELECT page_id AS case_id, url FROM pages UNION ALL SELECT * FROM (VALUES "
        + ", ".join(f"({i}::BIGINT, {q(u)})" for i, u in URL_CASES)
        + ") AS v(case_id, url)",
    ),
    "messages": (
        [],
        "SELECT conv_id || '-' || turn AS message_id, role, text, CAST(role = 'user' AS INTEGER) AS label "
        "FROM conversations",
    ),
    "labelled": ([], "SELECT d.doc_id, d.text, l.toxic AS label FROM documents d JOIN labels l USING (doc_id)"),
    "nullable": (
        [],
        "SELECT doc_id, text, nullif(lang, 'de') AS department, nullif(source, 'src1') AS industry FROM documents",
    ),
    "scored": (
        ["ads", "bank"],
        """SELECT *, CAST(least(floor(p * CAST(100 AS DOUBLE)) + keyword_bonus, 100) AS INTEGER) AS risk_score FROM (
            SELECT *, CAST(least(3 * keyword_hits, 20) AS INTEGER) AS keyword_bonus FROM (
            SELECT a.doc_id, a.text, a.label, a.p, CAST(count(b.idx) AS INTEGER) AS keyword_hits
            FROM ads a LEFT JOIN bank b ON contains(lower(a.text), b.phrase) GROUP BY ALL))""",
    ),
    "predicted": (["ads"], "SELECT *, CAST(p > 0.5::DOUBLE AS INTEGER) AS predicted FROM ads"),
}


def sql(body: str, *names: str, recursive: bool = False, extra: list[tuple[str, str]] = ()) -> str:
    order: list[str] = []

    def need(name):
        for other in CTES[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{n} AS ({b})" for n, b in extra]
    if not parts:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"


def add(name: str, body: str, *names: str, **options) -> None:
    ORACLES[name] = sql(body, *names, **options)


# --- sources and sinks ---
add(
    "src_labelled_csv",
    "SELECT text, CASE label WHEN 1 THEN 'fake_sms' ELSE 'genuine_sms' END AS category, label FROM labelled",
    "labelled",
)
add(
    "src_reports_jsonl",
    "SELECT report_id, risk_score, fraud_category, evidence_text, reporter_name, 'CHROME_EXTENSION' AS report_type, "
    "CAST(hits AS INTEGER) AS n_phrases FROM reports JOIN report_hits USING (report_id, event_id) WHERE status <> 'REVIEWED'",
    "reports", "report_hits",
)
add(
    "src_reports_jsonl_lines",
    "SELECT count(*) FILTER (status <> 'REVIEWED') AS parsed, count(*) FILTER (status = 'REVIEWED') AS skipped FROM reports",
    "reports",
)


def cg(x: str) -> str:
    return f"'CG-' || upper(substr(sha256(CAST({x} AS VARCHAR)), 1, 8))"


add(
    "snk_reports_jsonl",
    f"SELECT {cg('event_id')} AS report_id, CAST(event_id AS VARCHAR) AS tab_id, risk_score, url, fraud_category FROM reports",
    "reports",
)
add(
    "snk_corpus_csv",
    "SELECT text, CASE label WHEN 1 THEN 'fake' ELSE 'genuine' END AS category, label FROM ads",
    "ads",
)

# --- projections ---
add(
    "src_job_postings",
    """SELECT doc_id, coalesce(department, 'Unknown') AS department, coalesce(industry, 'Not Specified') AS industry, ' ' AS benefits,
    CAST(doc_id % 2 AS INTEGER) AS fraudulent FROM nullable""",
    "nullable",
)
add(
    "src_sms_latin1",
    "SELECT regexp_replace(text, '[^\\x00-\\x{ff}]', '', 'g') AS text, '' AS category, label FROM labelled",
    "labelled",
)
add(
    "prj_fill_nulls",
    "SELECT doc_id, coalesce(department, 'Unknown') AS department, coalesce(industry, 'Not Specified') AS industry FROM nullable",
    "nullable",
)
add(
    "prj_combine_text",
    "SELECT doc_id, "
    + strip("coalesce(department, '') || ' ' || coalesce(text, '') || ' ' || coalesce(industry, '')")
    + " AS text FROM nullable",
    "nullable",
)
add("prj_normalise_jobs", f"SELECT doc_id, {normalise_jobs('text')} AS text FROM documents")
add("prj_normalise_sms", f"SELECT message_id, {normalise_sms('text')} AS text FROM messages", "messages")
add("prj_message_length", "SELECT message_id, CAST(length(text) AS INTEGER) AS message_length FROM messages", "messages")
add(
    "prj_tokens",
    "SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, array_to_string(w, ' ') AS tokens FROM "
    f"(SELECT doc_id, {tokens('text')} AS w FROM documents)",
)
add(
    "prj_ngrams",
    "SELECT doc_id, CAST(len(t) AS INTEGER) AS n_terms, array_to_string(t, '|') AS terms FROM "
    f"(SELECT doc_id, list_concat(w, {pairs('w', 2)}) AS t FROM (SELECT doc_id, {tokens('text')} AS w FROM documents))",
)


def page_text() -> str:
    body = r"regexp_replace(html, '(?is)^.*?<body\b[^>]*>', '')"
    body = rf"regexp_replace({body}, '(?s)<!--.*?-->', chr(1), 'g')"
    for tag in html.RAW_TAGS + html.NESTING_TAGS:
        body = rf"regexp_replace({body}, '(?is)<{tag}\b.*?</{tag}\s*>', chr(1), 'g')"
    nodes = rf"string_split(regexp_replace({body}, '<[a-zA-Z/!?][^>]*>', chr(1), 'g'), chr(1))"
    clean = "n"
    for entity, char in html.ENTITIES.items():
        clean = f"replace({clean}, {q(entity)}, {q(char)})"
    kept = f"list_filter(list_transform({nodes}, lambda n: {strip(clean)}), lambda n: length(n) > 3)"
    joined = rf"regexp_replace(array_to_string({kept}, ' '), '[\s\p{{Z}}]+', ' ', 'g')"
    return f"SELECT page_id, substr({joined}, 1, 3000) AS text FROM pages"


add("prj_page_text", page_text())
add(
    "prj_snippet",
    f"SELECT doc_id, substr({strip('text')}, 1, 200) AS text_snippet, substr(text, 1, 500) AS evidence_text FROM documents",
)


def highlight() -> str:
    out = "text"
    for phrase in sorted(banks.phrase_list(), key=len, reverse=True):
        out = rf"regexp_replace({out}, {q('(?i)' + chr(92) + 'Q' + phrase + chr(92) + 'E')}, '<mark>\0</mark>', 'g')"
    return f"SELECT doc_id, {out} AS highlighted FROM ads"


add("prj_highlight", highlight(), "ads")
add(
    "prj_report_card",
    r"SELECT report_id, CAST(hits AS INTEGER) AS flag_count, substr(regexp_replace(url, 'https?://', ''), 1, 30) AS short_url, "
    r"trim(split_part(fraud_category, '/', 1)) AS short_category FROM reports JOIN report_hits USING (report_id, event_id)",
    "reports", "report_hits",
)
HIT_ROWS = (
    "hit_rows",
    "SELECT a.doc_id, b.* FROM ads a JOIN bank b ON contains(lower(a.text), b.phrase)",
)
add(
    "prj_scan_digest",
    """SELECT a.doc_id, CAST(coalesce(t.n, 0) AS INTEGER) AS flag_total, coalesce(d.digest, '') AS digest FROM ads a
       LEFT JOIN (SELECT doc_id, count(*) AS n FROM hit_rows GROUP BY doc_id) t USING (doc_id)
       LEFT JOIN (SELECT doc_id, string_agg(line, '; ' ORDER BY cat_ord) AS digest FROM lines WHERE c <= 3 GROUP BY doc_id) d
       USING (doc_id)""",
    "ads",
    extra=[
        HIT_ROWS,
        (
            "lines",
            """SELECT doc_id, cat_ord, category || ': ' || string_agg(phrase, ', ' ORDER BY kw_ord) AS line,
               row_number() OVER (PARTITION BY doc_id ORDER BY cat_ord) AS c FROM
               (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY kw_ord) AS k FROM hit_rows)
               WHERE k <= 3 GROUP BY doc_id, cat_ord, category""",
        ),
    ],
)

# --- stemming ---


def stem_ctes(source: str) -> list[tuple[str, str]]:
    """CTEs that end in `stems(word, stem)` for the words of `source(text)`."""

    def match(x, pattern):
        return f"regexp_matches({x}, '{pattern}')"

    def cut(n, x="w"):
        return f"substr({x}, 1, length({x}) - {n})"

    def cvc(x):
        return f"({match(x, stem.CVC)} OR {match(x, stem.SHORT_VC)})"

    def suffix(name, prev, table):
        cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
        return [
            (f"{name}a", f"SELECT word, w, regexp_extract(w, '{stem.longest_suffix(table)}', 1) AS s FROM {prev}"),
            (
                name,
                f"""SELECT word, CASE WHEN s <> '' AND {match(f"CASE WHEN s = 'logi' THEN {cut(3)} ELSE {cut('length(s)')} END",
                stem.M_GT_0)} THEN {cut('length(s)')} || CASE s {cases} END ELSE w END AS w FROM {name}a""",
            ),
        ]

    double = f"(right(t, 1) = right({cut(1, 't')}, 1) AND length(t) > 1 AND {match('t', '[^aeiouy]$')})"
    special = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in stem.IRREGULAR.items())
    return [
        ("w0", f"SELECT DISTINCT unnest({words('text')}) AS word FROM {source}"),
        ("w1", "SELECT word, regexp_replace(word, '^y', 'Y') AS w FROM w0"),
        (
            "w2",
            f"""SELECT word, CASE WHEN ends_with(w, 'ies') AND length(w) = 4 THEN {cut(1)}
            WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut(2)} WHEN ends_with(w, 'ss') THEN w
            WHEN ends_with(w, 's') THEN {cut(1)} ELSE w END AS w FROM w1""",
        ),
        (
            "w3",
            f"""SELECT word, w, CASE WHEN ends_with(w, 'ied') OR ends_with(w, 'eed') THEN NULL
            WHEN ends_with(w, 'ed') THEN CASE WHEN {match(cut(2), stem.HAS_VOWEL)} THEN {cut(2)} END
            WHEN ends_with(w, 'ing') AND {match(cut(3), stem.HAS_VOWEL)} THEN {cut(3)} END AS t FROM w2""",
        ),
        (
            "w4",
            f"""SELECT word, CASE
            WHEN ends_with(w, 'ied') THEN CASE WHEN length(w) = 4 THEN {cut(1)} ELSE {cut(2)} END
            WHEN ends_with(w, 'eed') THEN CASE WHEN {match(cut(3), stem.M_GT_0)} THEN {cut(1)} ELSE w END
            WHEN t IS NULL THEN w
            WHEN ends_with(t, 'at') OR ends_with(t, 'bl') OR ends_with(t, 'iz') THEN t || 'e'
            WHEN {double} THEN CASE WHEN {match('t', '[lsz]$')} THEN t ELSE {cut(1, 't')} END
            WHEN {match('t', stem.M_EQ_1)} AND {cvc('t')} THEN t || 'e' ELSE t END AS w FROM w3""",
        ),
        ("w5", f"SELECT word, CASE WHEN {match('w', stem.FINAL_Y)} THEN {cut(1)} || 'i' ELSE w END AS w FROM w4"),
        (
            "w6",
            f"SELECT word, CASE WHEN ends_with(w, 'alli') AND {match(cut(4), stem.M_GT_0)} THEN {cut(2)} ELSE w END AS w FROM w5",
        ),
        *suffix("w7", "w6", stem.STEP2),
        *suffix("w8", "w7", stem.STEP3),
        ("w9a", f"SELECT word, w, regexp_extract(w, '{stem.longest_suffix(stem.STEP4)}', 1) AS s FROM w8"),
        (
            "w9",
            f"""SELECT word, CASE WHEN s <> '' AND {match(cut('length(s)'), stem.M_GT_1)}
            AND (s <> 'ion' OR {match(cut('length(s)'), '[st]$')}) THEN {cut('length(s)')} ELSE w END AS w FROM w9a""",
        ),
        (
            "w10",
            f"""SELECT word, CASE WHEN ends_with(w, 'e') AND ({match(cut(1), stem.M_GT_1)} OR
            ({match(cut(1), stem.M_EQ_1)} AND NOT {cvc(cut(1))})) THEN {cut(1)} ELSE w END AS w FROM w9""",
        ),
        ("w11", f"SELECT word, CASE WHEN ends_with(w, 'll') AND {match(cut(1), stem.M_GT_1)} THEN {cut(1)} ELSE w END AS w FROM w10"),
        (
            "stems",
            f"""SELECT word, CASE WHEN length(word) <= 2 THEN word ELSE
            coalesce(CASE word {special} END, regexp_replace(w, '^Y', 'y')) END AS stem FROM w11""",
        ),
    ]


add(
    "prj_stem_vocabulary",
    "SELECT word, stem FROM stems",
    "ads",
    extra=[("clean", f"SELECT doc_id, {normalise_sms('text')} AS text FROM ads"), *stem_ctes("clean")],
)
add(
    "prj_stem_text",
    "SELECT c.message_id, coalesce(t.text, '') AS text FROM clean c LEFT JOIN (SELECT message_id, "
    "string_agg(stem, ' ' ORDER BY pos) AS text FROM spots JOIN stems USING (word) GROUP BY message_id) t USING (message_id)",
    "messages",
    extra=[
        ("clean", f"SELECT message_id, {normalise_sms('text')} AS text FROM messages"),
        *stem_ctes("clean"),
        (
            "spots",
            f"SELECT message_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM "
            f"(SELECT message_id, {words('text')} AS w FROM clean)",
        ),
    ],
)

# --- filters ---
add(
    "flt_text_bounds",
    f"SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars FROM ads WHERE length(text) BETWEEN 5 AND 10000 AND {strip('text')} <> ''",
    "ads",
)
add(
    "flt_page_gate",
    f"SELECT doc_id, hits FROM (SELECT *, CAST(len({hits('text', banks.TRIGGERS)}) AS INTEGER) AS hits FROM ads) "
    "WHERE length(text) >= 30 AND (p >= 0.95::DOUBLE OR hits >= 2)",
    "ads",
)
add("flt_message_gate", "SELECT message_id, CAST(length(text) AS INTEGER) AS n_chars FROM messages WHERE length(text) >= 10", "messages")
add(
    "flt_drop_null",
    "SELECT doc_id, department, industry FROM nullable WHERE text IS NOT NULL AND department IS NOT NULL AND industry IS NOT NULL",
    "nullable",
)
add(
    "flt_reports",
    "SELECT report_id, event_id, risk_score, status, received_at FROM reports WHERE risk_score >= 30 AND status = 'FILED' "
    "ORDER BY received_at DESC, event_id DESC LIMIT 50",
    "reports",
)
add(
    "flt_report_search",
    "SELECT report_id, risk_score, fraud_category, url, reporter_name FROM reports WHERE risk_score >= 20 AND "
    "fraud_category = 'Financial Loan Scam' AND (contains(lower(url), 'user-1') OR contains(lower(reporter_name), 'user-1'))",
    "reports",
)
add(
    "flt_reportable",
    "SELECT doc_id, risk_score, 'bot' AS surface FROM scored WHERE risk_score > 40 UNION ALL "
    "SELECT doc_id, risk_score, 'popup' FROM scored WHERE doc_id % 7 <> 0 AND risk_score <> 0",
    "scored",
)

# --- rules ---
add("rule_keyword_bonus", "SELECT doc_id, keyword_hits, keyword_bonus FROM scored", "scored")
add("rule_risk_score", "SELECT doc_id, risk_score FROM scored", "scored")
add(
    "rule_verdict",
    f"""SELECT doc_id, CASE WHEN risk_score > 40 THEN 'FAKE' ELSE 'GENUINE' END AS verdict,
    CASE WHEN risk_score > 40 THEN {fraud_type('text', 'service')} ELSE 'Not Applicable' END AS fraud_category,
    CASE WHEN p > 0.5::DOUBLE THEN 'FAKE' ELSE 'GENUINE' END AS ui_verdict, {fraud_type('text', 'ui')} AS ui_category FROM scored""",
    "scored",
)
add(
    "rule_fraud_type",
    f"SELECT doc_id, {fraud_type('text', 'service')} AS service_type, {fraud_type('text', 'ui')} AS ui_type FROM ads",
    "ads",
)


def url_ctes(profile: str, source: str = "url_cases") -> list[tuple[str, str]]:
    points, text = banks.URL_POINTS, banks.URL_MESSAGES[profile]
    tests = {
        "ip": r"CASE WHEN regexp_matches(dom, '^\d{1,3}(\.\d{1,3}){3}') THEN '' END",
        "http": "CASE WHEN starts_with(f, 'http://') THEN '' END",
        "tld": f"list_filter({arr(banks.TLDS)}, lambda t: ends_with(dom, t))[1]",
        "host": f"list_filter({arr(banks.HOSTS[profile])}, lambda t: contains(dom, t))[1]",
        "brand": f"list_filter({arr(banks.BRANDS[profile])}, lambda t: contains(dom, t) AND NOT contains(dom, t || '.com') "
        "AND NOT contains(dom, t || '.co.in'))[1]",
        "dots": "CASE WHEN length(dom) - length(replace(dom, '.', '')) >= 3 THEN '' END",
    }
    if profile == "ui":
        tests["word"] = f"list_filter({arr(banks.URL_WORDS)}, lambda t: contains(lower(f), t))[1]"
        tests["long"] = "CASE WHEN length(f) > 100 THEN '' END"
        tests["digits"] = r"CASE WHEN regexp_matches(dom, '\d{4,}') THEN '' END"
    messages = []
    for rule in tests:
        before, _, after = text[rule].partition("{}")
        messages.append(f"{q(before)} || {rule} || {q(after)}")
    total = " + ".join(f"CASE WHEN {rule} IS NULL THEN 0 ELSE {points[rule]} END" for rule in tests)
    missing = "url = '' OR url = 'about:blank'" if profile == "service" else f"{strip('url')} = ''"
    bad = "(contains(dom, '[') <> contains(dom, ']'))"
    name = f"checked_{profile}"
    return [
        (
            f"{name}0",
            "SELECT *, CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN url ELSE 'http://' || url END AS f "
            f"FROM {source}",
        ),
        (f"{name}1", rf"SELECT *, lower(regexp_extract(f, '^https?://([^/?#]*)', 1)) AS dom FROM {name}0"),
        (f"{name}2", f"SELECT *, {', '.join(f'{t} AS {r}' for r, t in tests.items())} FROM {name}1"),
        (
            name,
            f"""SELECT *, CAST(CASE WHEN {missing} THEN 0 WHEN {bad} THEN {banks.BAD_URL_SCORE[profile]}
            ELSE least({total}, 100) END AS INTEGER) AS url_risk_score,
            CASE WHEN {missing} THEN [] WHEN {bad} THEN [{q(text['bad'])}]
            ELSE list_filter([{', '.join(messages)}], lambda m: m IS NOT NULL) END AS url_flags FROM {name}2""",
        ),
    ]


add(
    "rule_url_flags",
    "SELECT case_id, 'service' AS profile, url_risk_score, array_to_string(url_flags, ' | ') AS flags FROM checked_service UNION ALL "
    "SELECT case_id, 'ui', url_risk_score, array_to_string(url_flags, ' | ') FROM checked_ui",
    "url_cases",
    extra=url_ctes("service") + url_ctes("ui"),
)
LEVELS = " ".join(f"WHEN url_risk_score >= {n} THEN {q(t)}" for n, t in banks.URL_LEVELS[:-1])
add(
    "rule_url_level",
    f"SELECT case_id, CASE WHEN list_contains(url_flags, {q(banks.URL_MESSAGES['ui']['bad'])}) OR {strip('url')} = '' THEN '' {LEVELS} "
    f"ELSE {q(banks.URL_LEVELS[-1][1])} END AS level, url_risk_score >= 20 AS is_suspicious FROM checked_ui",
    "url_cases",
    extra=url_ctes("ui"),
)
add(
    "rule_risk_band",
    f"SELECT doc_id, {band('risk_score', 'floor')} AS floor_band, {band('risk_score', 'ceiling')} AS ceiling_band, "
    f"{band('risk_score', 'chat')} AS chat_band FROM scored",
    "scored",
)
ALLOW, SCAM = banks.OVERRIDES[0][0], [w for w, _, _ in banks.OVERRIDES[1:]]
add(
    "rule_override",
    f"""SELECT doc_id, CASE WHEN contains(lower(text), '{ALLOW}') THEN 2.15::DOUBLE WHEN len({hits('text', SCAM)}) > 0 THEN 98.42::DOUBLE
    ELSE round(p * 100::DOUBLE, 2) END AS risk_score, CASE WHEN contains(lower(text), '{ALLOW}') THEN 'Safe'
    WHEN len({hits('text', SCAM)}) > 0 OR round(p * 100::DOUBLE, 2) > 50 THEN 'Scam' ELSE 'Safe' END AS label FROM ads""",
    "ads",
)
add(
    "rule_text_label",
    "SELECT doc_id, round(p * 100::DOUBLE, 2) AS risk_score, CASE WHEN p * 100::DOUBLE > 50 THEN 'Scam' ELSE 'Safe' END AS label FROM ads",
    "ads",
)

# --- joins ---
add("jn_keyword_hits", "SELECT doc_id, category, phrase FROM hit_rows", "ads", extra=[HIT_ROWS])
add(
    "jn_trigger_hits",
    f"SELECT doc_id, phrase FROM ads JOIN (SELECT unnest({arr(banks.TRIGGERS)}) AS phrase) ON contains(lower(text), phrase)",
    "ads",
)
PHRASES = (
    "phrases",
    f"""SELECT event_id, unnest(list_concat({pairs('w', 2)}, {pairs('w', 3)})) AS phrase FROM (SELECT event_id,
    regexp_extract_all(lower(evidence_text || ' ' || comment), '\\b[a-z₹\\d]+\\b') AS w FROM reports WHERE risk_score >= 70)""",
)
LEARNED = ("learned", "SELECT phrase, count(*) AS n FROM phrases GROUP BY phrase HAVING count(*) >= 3")
add(
    "jn_learned_hits",
    "SELECT doc_id, phrase FROM ads JOIN learned ON contains(lower(text), phrase)",
    "reports", "ads",
    extra=[PHRASES, LEARNED],
)
DOC_TERMS = ("doc_terms", f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY ALL")
DOC_FREQ = ("freq", "SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS cf FROM doc_terms GROUP BY term")
add(
    "jn_tfidf",
    """SELECT doc_id, term, n, df, round(n * (ln((c.n_docs + 1)::DOUBLE / (df + 1)::DOUBLE) + 1), 6) AS tfidf
    FROM doc_terms JOIN freq USING (term) CROSS JOIN (SELECT count(*) AS n_docs FROM documents) c""",
    extra=[DOC_TERMS, DOC_FREQ],
)
add(
    "jn_screen_assemble",
    f"""SELECT doc_id, risk_score, CASE WHEN risk_score > 40 THEN 'FAKE' ELSE 'GENUINE' END AS verdict,
    CASE WHEN risk_score > 40 THEN {fraud_type('text', 'service')} ELSE 'Not Applicable' END AS fraud_category,
    keyword_hits, url_risk_score, array_to_string(url_flags, ' | ') AS url_flags, round(p, 4) AS model_confidence,
    substr({strip('text')}, 1, 200) AS text_snippet
    FROM checked_service WHERE length(text) BETWEEN 5 AND 10000 AND {strip('text')} <> ''""",
    "scored",
    extra=[
        ("ad_pages", "SELECT s.*, coalesce(p.url, '') AS url FROM scored s LEFT JOIN pages p ON p.page_id = s.doc_id"),
        *url_ctes("service", "ad_pages"),
    ],
)
add(
    "jn_new_phrases",
    "SELECT phrase, n FROM learned WHERE phrase NOT IN (SELECT phrase FROM bank)",
    "reports",
    extra=[PHRASES, LEARNED],
)


def dedup_ctes() -> list[tuple[str, str]]:
    return [
        (
            "hashed",
            "SELECT *, substr(sha256(url), 1, 16) AS url_hash, epoch_us(received_at) AS t, row_number() OVER "
            "(PARTITION BY substr(sha256(url), 1, 16) ORDER BY received_at, event_id) AS rn FROM reports",
        ),
        (
            "greedy",
            """SELECT event_id, url_hash, rn, t AS kept, event_id AS origin, true AS accepted FROM hashed WHERE rn = 1
            UNION ALL SELECT h.event_id, h.url_hash, h.rn,
            CASE WHEN h.t - g.kept >= 86400000000 THEN h.t ELSE g.kept END,
            CASE WHEN h.t - g.kept >= 86400000000 THEN h.event_id ELSE g.origin END, h.t - g.kept >= 86400000000
            FROM greedy g JOIN hashed h ON h.url_hash = g.url_hash AND h.rn = g.rn + 1""",
        ),
    ]


add(
    "jn_duplicate_origin",
    f"SELECT event_id, origin, CASE WHEN accepted THEN {cg('event_id')} ELSE {cg('origin')} || '-DUP' END AS answer FROM greedy",
    "reports",
    recursive=True,
    extra=dedup_ctes(),
)
for name in ("st_dedup_reports", "st_dedup_reports_stream"):
    add(name, "SELECT event_id, url_hash, accepted, origin FROM greedy", "reports", recursive=True, extra=dedup_ctes())
add(
    "snk_reports_table",
    """SELECT h.event_id, h.url_hash, h.risk_score, 'FILED' AS status, substr(h.evidence_text, 1, 500) AS evidence_text,
    CAST(h.received_at AS DATE) AS filed_on FROM hashed h JOIN greedy g USING (event_id) WHERE g.accepted""",
    "reports",
    recursive=True,
    extra=dedup_ctes(),
)
for name in ("st_rate_limit", "st_rate_limit_stream"):
    add(
        name,
        "SELECT event_id, client, accepted FROM limiter",
        "reports",
        recursive=True,
        extra=[
            (
                "hits",
                "SELECT event_id, client, epoch_us(received_at) AS t, row_number() OVER (PARTITION BY client "
                "ORDER BY received_at, event_id) AS rn FROM reports",
            ),
            (
                "limiter",
                """SELECT event_id, client, rn, [t] AS times, true AS accepted FROM hits WHERE rn = 1 UNION ALL
                SELECT event_id, client, rn, CASE WHEN len(live) < 2 THEN list_append(live, t) ELSE live END, len(live) < 2 FROM
                (SELECT h.event_id, h.client, h.rn, h.t, list_filter(l.times, lambda x: h.t - x < 86400000000) AS live
                FROM limiter l JOIN hits h ON h.client = l.client AND h.rn = l.rn + 1)""",
            ),
        ],
    )

# --- aggregations ---
add(
    "agg_keyword_map",
    "SELECT doc_id, category, string_agg(phrase, '|' ORDER BY kw_ord) AS phrases FROM hit_rows GROUP BY doc_id, category",
    "ads",
    extra=[HIT_ROWS],
)
STATS = "count(*) AS total_reports, count(*) FILTER (risk_score >= 70) AS high_risk"
AVG = "coalesce(round(avg(risk_score), 1), 0) AS avg_risk_score"
add(
    "agg_report_stats",
    f"SELECT {STATS}, count(*) FILTER (CAST(received_at AS DATE) = DATE '{AS_OF}') AS filed_today, {AVG} FROM reports",
    "reports",
)
add(
    "st_report_stats",
    f"SELECT {STATS}, count(*) FILTER (CAST(received_at AS DATE) = DATE '{AS_OF}') AS filed_today, {AVG} FROM reports",
    "reports",
)
add("agg_reports_by_category", "SELECT fraud_category, count(*) AS n FROM reports GROUP BY fraud_category", "reports")
add("agg_label_counts", "SELECT label, count(*) AS n FROM labelled GROUP BY label", "labelled")
add(
    "agg_null_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_null, count(*) AS n_rows, 4 AS n_columns FROM nullable"
        for c in ("doc_id", "text", "department", "industry")
    ),
    "nullable",
)
add("agg_length_by_class", "SELECT role, round(avg(length(text)), 6) AS mean_length FROM messages GROUP BY role", "messages")
add("agg_doc_freq", "SELECT term, df, cf FROM freq", extra=[DOC_TERMS, DOC_FREQ])
add("agg_phrase_counts", "SELECT phrase, n FROM learned", "reports", extra=[PHRASES, LEARNED])
add("st_learn_keywords", "SELECT phrase, n FROM learned", "reports", extra=[PHRASES, LEARNED])
add(
    "agg_phrase_reports",
    "SELECT phrase, count(DISTINCT event_id) AS n FROM phrases GROUP BY phrase HAVING count(DISTINCT event_id) >= 3",
    "reports",
    extra=[PHRASES],
)
add(
    "agg_confusion",
    "SELECT label AS actual, count(*) FILTER (predicted = 0) AS predicted_0, count(*) FILTER (predicted = 1) AS predicted_1 "
    "FROM predicted GROUP BY label",
    "predicted",
)
REPORT = [
    (
        "c",
        "SELECT count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 1) AS fp, "
        "count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 0 AND predicted = 0) AS tn FROM predicted",
    ),
    (
        "m",
        """SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM (
        SELECT '0' AS class, CASE WHEN tn + fn = 0 THEN 0 ELSE tn::DOUBLE / (tn + fn) END AS pr,
        CASE WHEN tn + fp = 0 THEN 0 ELSE tn::DOUBLE / (tn + fp) END AS re, tn + fp AS support FROM c UNION ALL
        SELECT '1', CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END,
        CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, tp + fn FROM c)""",
    ),
    (
        "report",
        """SELECT class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, support FROM m
        UNION ALL SELECT 'accuracy', round(a, 6), round(a, 6), round(a, 6), n FROM
          (SELECT (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS a, tp + fp + fn + tn AS n FROM c)
        UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m
        UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6),
          round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m""",
    ),
]
add("agg_class_report", "SELECT * FROM report", "predicted", extra=REPORT)
add(
    "agg_model_stats",
    """SELECT round(max(precision) FILTER (class = 'accuracy') * 100, 1) AS accuracy,
    round(max(precision) FILTER (class = '1') * 100, 1) AS precision, round(max(recall) FILTER (class = '1') * 100, 1) AS recall,
    round(max(f1) FILTER (class = '1') * 100, 1) AS f1_score, max(support) FILTER (class = 'accuracy') AS n_test FROM report""",
    "predicted",
    extra=REPORT,
)
add(
    "agg_roc_auc",
    """SELECT round((sum(r) FILTER (label = 1) - np * (np + 1) / 2) / (np * nn), 6) AS auc FROM (
    SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2::DOUBLE AS r,
    count(*) FILTER (label = 1) OVER () AS np, count(*) FILTER (label = 0) OVER () AS nn FROM ads) GROUP BY np, nn""",
    "ads",
)
add(
    "win_roc_curve",
    """SELECT p AS threshold, round(sum(neg) OVER w / (sum(neg) OVER ())::DOUBLE, 6) AS fpr,
    round(sum(pos) OVER w / (sum(pos) OVER ())::DOUBLE, 6) AS tpr FROM (SELECT p, count(*) FILTER (label = 1) AS pos,
    count(*) FILTER (label = 0) AS neg FROM ads GROUP BY p) WINDOW w AS (ORDER BY p DESC)""",
    "ads",
)
add(
    "agg_ocr_text",
    r"""SELECT image_id, coalesce(string_agg(word, ' ' ORDER BY word_idx) FILTER (conf > 40 AND regexp_replace(word, '[\s\p{Z}]', '', 'g') <> ''), '') AS text,
    round(coalesce(avg(conf) FILTER (conf > 0), 0), 1) AS confidence,
    CAST(count(*) FILTER (conf > 40 AND regexp_replace(word, '[\s\p{Z}]', '', 'g') <> '') AS INTEGER) AS word_count FROM ocr GROUP BY image_id""",
    extra=[
        (
            "ocr",
            """SELECT image_id, word_idx, word, CAST((image_id * 31 + word_idx * 17) % 102 - 1 AS INTEGER) AS conf FROM (
            SELECT doc_id AS image_id, unnest(w) AS word, unnest(range(0, len(w))) AS word_idx FROM
            (SELECT doc_id, string_split(text, ' ') AS w FROM documents))""",
        )
    ],
)
add(
    "agg_url_flag_summary",
    "SELECT flag, count(*) AS pages, round(avg(url_risk_score), 6) AS mean_score FROM "
    "(SELECT url_risk_score, unnest(url_flags) AS flag FROM checked_service) GROUP BY flag",
    "url_cases",
    extra=url_ctes("service"),
)

# --- windows, sorts, sets ---
add(
    "win_stratified_split",
    f"""SELECT doc_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {draw_sql(SEED, 'doc_id')}, doc_id)
    <= ceil(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM labelled""",
    "labelled",
)
SPLIT = f"CASE WHEN {draw_sql(SEED, '{}')} % 100 < 20 THEN 'test' ELSE 'train' END"
add("win_random_split", f"SELECT doc_id, {SPLIT.format('doc_id')} AS split FROM documents")
add(
    "win_top_words",
    f"""SELECT label, word, n, CAST(rank AS INTEGER) AS rank FROM (SELECT label, word, n, row_number() OVER (PARTITION BY label
    ORDER BY n DESC, word) AS rank FROM (SELECT label, word, count(*) AS n FROM (SELECT label,
    unnest({words(normalise_jobs('text'))}) AS word FROM labelled) GROUP BY ALL)) WHERE rank <= 20""",
    "labelled",
)
GAP = """SELECT user_id, event_id, ts FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt
    FROM events) WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) > 3600000000"""
add("win_chatter_gap", GAP)
add("st_debounce", GAP)
add(
    "srt_recent_reports",
    "SELECT report_id, received_at, risk_score, (SELECT count(*) FROM reports) AS total FROM reports "
    "ORDER BY received_at DESC, event_id DESC LIMIT 20",
    "reports",
)
add(
    "srt_longest_messages",
    "SELECT message_id, CAST(length(text) AS INTEGER) AS message_length FROM messages ORDER BY length(text) DESC, message_id LIMIT 5",
    "messages",
)
add(
    "srt_sample_rows",
    f"SELECT doc_id, label AS actual, predicted FROM predicted ORDER BY {draw_sql(SEED, 'doc_id')}, doc_id LIMIT 10",
    "predicted",
)
add(
    "set_union_corpora",
    "SELECT text, label FROM labelled UNION ALL SELECT text, label FROM messages UNION ALL SELECT text, label FROM ads",
    "labelled", "messages", "ads",
)
add(
    "set_distinct_text",
    "SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1",
)

# --- augmentation ---


def synonym_ctes(source: str, keys: list[str], variant: str, prefix: str = "syn") -> list[tuple[str, str]]:
    """CTEs that end in `<prefix>`: source with the column t rewritten."""
    out, prev = [], source
    for step, (phrase, others) in enumerate(banks.SYNONYMS.items()):
        pick = draw_sql(SEED, "doc_id", variant, f"'syn{step}'")
        name = prefix if step == len(banks.SYNONYMS) - 1 else f"{prefix}{step}"
        out.append(
            (
                name,
                f"SELECT {', '.join(keys)}, CASE WHEN contains(lower(t), {q(phrase)}) THEN regexp_replace(t, {q(phrase)}, "
                f"{arr(others)}[{pick} % {len(others)} + 1], 'i') ELSE t END AS t FROM {prev}",
            )
        )
        prev = name
    return out


def numbers(x: str, variant: str) -> str:
    value = "try_cast(replace(amt[i], ',', '') AS BIGINT)"
    down, up = f"CAST(floor({value} * 0.15::DOUBLE) AS BIGINT)", f"CAST(floor({value} * 0.20::DOUBLE) AS BIGINT)"
    pick = draw_sql(SEED, "doc_id", variant, "('num' || (i - 1))")
    moved = f"greatest({value} - {down} + {pick} % ({down} + {up} + 1), 100)"
    return f"""(SELECT array_to_string(list_transform(range(1, len(pcs) + 1), lambda i: pcs[i] || CASE WHEN i > len(amt) THEN '' ELSE
    '₹' || CASE WHEN {value} IS NULL THEN amt[i] ELSE format('{{:,}}', {moved}) END END), '') FROM (SELECT string_split_regex({x}, '₹[\\d,]+') AS pcs,
    regexp_extract_all({x}, '₹([\\d,]+)', 1) AS amt))"""


def sentences(x: str, variant: str) -> str:
    kept = f"list_filter(list_transform(string_split_regex({x}, '[.!?]'), lambda s: {strip('s')}), lambda s: s <> '')"
    keyed = (
        "list_sort(list_transform(range(1, len(k) + 1), lambda i: "
        f"{{'h': {draw_sql(SEED, 'doc_id', variant, chr(40) + chr(39) + 'sent' + chr(39) + ' || (i - 1))')}, 'i': i, 's': k[i]}}))"
    )
    return (
        f"(SELECT array_to_string(CASE WHEN len(k) > 2 THEN list_transform({keyed}, lambda e: e.s) ELSE k END, '. ') || '.' "
        f"FROM (SELECT {kept} AS k))"
    )


add(
    "aug_synonyms",
    "SELECT doc_id, t AS text FROM syn",
    "ads",
    extra=[("base", "SELECT doc_id, text AS t FROM ads"), *synonym_ctes("base", ["doc_id"], "0")],
)
add("aug_numbers", f"SELECT doc_id, {numbers('text', '0')} AS text FROM ads", "ads")
add("aug_sentence_shuffle", f"SELECT doc_id, {sentences('text', '0')} AS text FROM ads", "ads")
MODE = draw_sql(SEED, "doc_id", "variant", "'mode'") + " / 4294967296::DOUBLE"
add(
    "aug_expand",
    """SELECT doc_id, variant, text, category, label FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id * 5 + variant) AS rn
    FROM stacked) WHERE rn = 1""",
    "ads",
    extra=[
        (
            "vars",
            f"SELECT doc_id, text, variant, {MODE} AS mode, text AS t FROM ads CROSS JOIN (SELECT unnest(range(1, 5))::INTEGER AS variant) "
            "WHERE label = 1",
        ),
        *synonym_ctes("vars", ["doc_id", "text", "variant", "mode"], "variant"),
        (
            "made",
            f"SELECT doc_id, variant, text AS old, CASE WHEN mode < 0.4::DOUBLE THEN t WHEN mode < 0.7::DOUBLE THEN {numbers('text', 'variant')} "
            f"ELSE {sentences('t', 'variant')} END AS text FROM syn",
        ),
        (
            "stacked",
            "SELECT doc_id, 0 AS variant, text, CASE label WHEN 1 THEN 'fake' ELSE 'genuine' END AS category, label FROM ads UNION ALL "
            "SELECT doc_id, variant, text, 'fake', 1 FROM made WHERE text <> old",
        ),
    ],
)

ORACLES["ml_augmented_forest"] = (
    "SELECT label, CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT) AS support, TRUE AS beats_majority "
    f"FROM ({ORACLES['aug_expand']}) GROUP BY label"
)

# --- learning ---


def feature_ctes(
    source: str, id_col: str, terms: str, k: int | None, sublinear: bool = False, train: bool = True, scope: str = "tr",
) -> list[tuple[str, str]]:
    """CTEs tc(id, term, n), voc(term, idf), wt(id, term, weight), tr(ids of the training rows); scope holds the ids that make voc."""
    tf = "1 + ln(n::DOUBLE)" if sublinear else "n::DOUBLE"
    where = f"WHERE {SPLIT.format(id_col)} = 'train'" if train else ""
    cut = f"ORDER BY cf DESC, term LIMIT {k}" if k else ""
    return [
        ("tr", f"SELECT {id_col}, label FROM {source} {where}"),
        (
            "tc",
            f"SELECT {id_col}, term, count(*) AS n FROM (SELECT {id_col}, unnest({terms}) AS term FROM "
            f"(SELECT {id_col}, {tokens('text')} AS w FROM {source})) GROUP BY ALL",
        ),
        (
            "voc",
            f"""SELECT term, df, ln((c.n_docs + 1)::DOUBLE / (df + 1)::DOUBLE) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(n) AS cf
            FROM tc JOIN {scope} USING ({id_col}) GROUP BY term {cut})
            CROSS JOIN (SELECT count(*) AS n_docs FROM {scope}) c""",
        ),
        (
            "wt",
            f"""SELECT {id_col}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {id_col})) AS weight FROM
            (SELECT {id_col}, term, ({tf}) * idf AS raw FROM tc JOIN voc USING (term))""",
        ),
    ]


def bayes_ctes(id_col: str, weights: str, alpha: float) -> list[tuple[str, str]]:
    return [
        (
            "sums",
            f"""SELECT v.term, coalesce(sum(w.weight) FILTER (tr.label = 0), 0)::DOUBLE AS s0,
            coalesce(sum(w.weight) FILTER (tr.label = 1), 0)::DOUBLE AS s1 FROM voc v LEFT JOIN
            ({weights}) w ON w.term = v.term LEFT JOIN tr ON tr.{id_col} = w.{id_col} GROUP BY v.term""",
        ),
        (
            "params",
            f"""SELECT term, ln(s0 + {alpha}::DOUBLE) - ln(t0 + {alpha}::DOUBLE * v) AS lp0, ln(s1 + {alpha}::DOUBLE) - ln(t1 + {alpha}::DOUBLE * v) AS lp1
            FROM sums CROSS JOIN (SELECT sum(s0) AS t0, sum(s1) AS t1, count(*) AS v FROM sums)""",
        ),
    ]


GRAMS = f"list_concat(w, {pairs('w', 2)})"
add(
    "ml_tfidf",
    "SELECT doc_id, term, round(weight, 6) AS weight FROM wt",
    "ads",
    extra=feature_ctes("ads", "doc_id", GRAMS, 5000, sublinear=True),
)
add(
    "ml_count_vectors",
    f"SELECT message_id, term, count(*) AS n FROM (SELECT message_id, unnest({tokens(normalise_sms('text'))}) AS term FROM messages) GROUP BY ALL",
    "messages",
)
NB = feature_ctes("ads", "doc_id", "w", 5000) + bayes_ctes("doc_id", "SELECT * FROM wt", 1.0)
NAMED = "SELECT term, round(lp0, 6) AS log_prob_0, round(lp1, 6) AS log_prob_1 FROM params"
add("ml_naive_bayes", NAMED, "ads", extra=NB)
add(
    "ml_naive_bayes_counts",
    NAMED,
    "messages",
    extra=[
        ("clean", f"SELECT message_id, label, {normalise_sms('text')} AS text FROM messages"),
        *feature_ctes("clean", "message_id", "w", None),
        *bayes_ctes("message_id", "SELECT message_id, term, n::DOUBLE AS weight FROM tc", 0.1),
    ],
)
NB_ALL = feature_ctes("ads", "doc_id", "w", 5000, scope="ads") + bayes_ctes("doc_id", "SELECT * FROM wt", 1.0)
for name, ctes in (("ml_predict", NB), ("ml_predict_fit_all", NB_ALL)):
    add(
        name,
        f"""SELECT doc_id, round(1 / (1 + exp(-odds)), 6) AS p, CAST(odds > 0 AS INTEGER) AS predicted FROM (
        SELECT a.doc_id, coalesce(s.margin, 0) + pr.prior AS odds FROM ads a LEFT JOIN (SELECT doc_id, sum(weight * (lp1 - lp0)) AS margin
    FROM wt JOIN params USING (term) GROUP BY doc_id) s USING (doc_id) CROSS JOIN (SELECT ln((count(*) FILTER (label = 1))::DOUBLE)
        - ln((count(*) FILTER (label = 0))::DOUBLE) AS prior FROM tr) pr WHERE {SPLIT.format('a.doc_id')} = 'test')""",
        "ads",
        extra=ctes,
    )
FEATURES = feature_ctes("ads", "doc_id", GRAMS, 5000)


def gini(a: str, b: str) -> str:
    n = f"(({a}) + ({b}))::DOUBLE"
    return f"CASE WHEN {n} > 0 THEN 1 - (({a}) / {n}) * (({a}) / {n}) - (({b}) / {n}) * (({b}) / {n}) ELSE 0 END"


GAINS = (
    "gains",
    f"""SELECT term AS phrase, round({gini("t0", "t1")} - ((n0 + n1) / (t0 + t1)::DOUBLE * ({gini("n0", "n1")})
    + (t0 - n0 + t1 - n1) / (t0 + t1)::DOUBLE * ({gini("t0 - n0", "t1 - n1")})), 9) AS gain
    FROM (SELECT voc.term, count(*) FILTER (tr.label = 0) AS n0, count(*) FILTER (tr.label = 1) AS n1
          FROM voc LEFT JOIN tc ON tc.term = voc.term LEFT JOIN tr ON tr.doc_id = tc.doc_id GROUP BY voc.term)
    CROSS JOIN (SELECT count(*) FILTER (label = 0) AS t0, count(*) FILTER (label = 1) AS t1 FROM tr)""",
)
add(
    "snk_keyword_bank",
    "SELECT phrase, (SELECT count(*) FROM learned) AS total_learned, 100::BIGINT AS n_model, TRUE AS strong, TRUE AS whole FROM learned",
    "ads", "reports",
    extra=[PHRASES, LEARNED],
)

PART = f"(SELECT doc_id, label FROM ads WHERE {SPLIT.format('doc_id')} = 'test')"
add("ml_random_forest", f"SELECT label, count(*) AS support, TRUE AS beats_majority FROM {PART} GROUP BY label", "ads")
add(
    "ml_logistic",
    f"SELECT label, count(*) AS support, TRUE AS beats_majority FROM messages WHERE {SPLIT.format('message_id')} = 'test' GROUP BY label",
    "messages",
)
add("ml_feature_importance", "SELECT phrase, gain, TRUE AS strong FROM gains", "ads", extra=[*FEATURES, GAINS])
add(
    "srt_top_keywords",
    "SELECT phrase, gain, row_number() OVER (ORDER BY gain DESC, phrase)::INTEGER AS rank, TRUE AS strong FROM gains ORDER BY gain DESC, phrase LIMIT 50",
    "ads",
    extra=[*FEATURES, GAINS],
)
add("snk_model", f"SELECT doc_id, TRUE AS same FROM {PART}", "ads")



def answered(source: str) -> list[tuple[str, str]]:
    """CTE `answered`: rows of source (text, p) with keyword_hits and risk_score."""
    n = f"CAST(len({hits('text', banks.phrase_list())}) AS INTEGER)"
    return [
        ("hit", f"SELECT *, {n} AS keyword_hits FROM {source}"),
        ("answered", "SELECT *, CAST(least(floor(p * 100::DOUBLE) + least(3 * keyword_hits, 20), 100) AS INTEGER) AS risk_score FROM hit"),
    ]


ANSWER = f"""risk_score, CASE WHEN risk_score > 40 THEN 'FAKE' ELSE 'GENUINE' END AS verdict,
    CASE WHEN risk_score > 40 THEN {fraud_type('text', 'service')} ELSE 'Not Applicable' END AS fraud_category, keyword_hits"""
BOUNDS = f"length(text) BETWEEN 5 AND 10000 AND {strip('text')} <> ''"
add(
    "jn_scan_pages",
    f"SELECT page_id, {ANSWER}, url_risk_score, substr({strip('text')}, 1, 200) AS text_snippet FROM checked_service WHERE {BOUNDS}",
    extra=[
        ("shown", page_text()),
        (
            "gated",
            f"""SELECT page_id, text, url, (page_id % 101)::DOUBLE / 100::DOUBLE AS p FROM shown JOIN pages USING (page_id)
            WHERE length(text) >= 30 AND (page_id % 3 = 0 OR len({hits('text', banks.TRIGGERS)}) >= 2)""",
        ),
        *answered("gated"),
        *url_ctes("service", "answered"),
    ],
)
MODEL_P = (
    "modelled",
    f"""SELECT doc_id, text, round(1 / (1 + exp(-odds)), 6) AS p FROM (SELECT a.doc_id, a.text, coalesce(s.margin, 0) + pr.prior AS odds
    FROM ads a LEFT JOIN (SELECT doc_id, sum(weight * (lp1 - lp0)) AS margin FROM wt JOIN params USING (term) GROUP BY doc_id) s USING (doc_id)
    CROSS JOIN (SELECT ln((count(*) FILTER (label = 1))::DOUBLE) - ln((count(*) FILTER (label = 0))::DOUBLE) AS prior FROM tr) pr
    WHERE {SPLIT.format('a.doc_id')} = 'test')""",
)
add(
    "jn_screen_with_model",
    f"SELECT doc_id, {ANSWER}, round(p, 4) AS model_confidence FROM answered WHERE {BOUNDS}",
    "ads",
    extra=[*NB, MODEL_P, *answered("modelled")],
)

ORACLES["st_screen_with_model"] = ORACLES["jn_screen_with_model"]

# --- streaming ---
AD_URL = ("ad_urls", "SELECT *, 'http://ads.example.xyz/' || doc_id AS url FROM scored")
add(
    "st_screen",
    f"""SELECT doc_id, risk_score, CASE WHEN risk_score > 40 THEN 'FAKE' ELSE 'GENUINE' END AS verdict,
    CASE WHEN risk_score > 40 THEN {fraud_type('text', 'service')} ELSE 'Not Applicable' END AS fraud_category,
    url_risk_score, substr({strip('text')}, 1, 200) AS text_snippet FROM checked_service
    WHERE length(text) BETWEEN 5 AND 10000 AND {strip('text')} <> ''""",
    "scored",
    extra=[AD_URL, *url_ctes("service", "ad_urls")],
)
add(
    "st_alerts",
    f"""SELECT doc_id, risk_score, (risk_score > 20 OR p = 0) AS badge, risk_score >= 80 AS alert FROM scored
    WHERE length(text) BETWEEN 5 AND 10000 AND {strip('text')} <> '' AND (risk_score > 20 OR p = 0 OR risk_score >= 80)""",
    "scored",
)
