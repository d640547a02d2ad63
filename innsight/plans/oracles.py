"""ANSI SQL for the queries, written on their own from the definitions.

Common table expressions are kept by name with what they read; ``_sql`` puts the ones a
query needs in front of it.
"""

from __future__ import annotations

import re

from innsight import config
from innsight.plans.adapters import TEST_ASPECTS, TEST_LEXICON

CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def _sql(body: str, base: str | None = None) -> str:
    """The query with the CTEs it (transitively) names, in definition order."""
    table = dict(CTES)
    if base:
        table["mentions"] = f"select * from {base}"
    needed: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"\b[a-z_0-9]+\b", todo.pop()))
        for name in words & set(table) - needed:
            needed.add(name)
            todo.append(table[name])
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in table:
            if other != name and other in needed and re.search(rf"\b{other}\b", table[name]):
                visit(other)
        order.append(name)

    for name in table:
        if name in needed:
            visit(name)
    if not order:
        return body
    return "with " + ",\n".join(f"{n} as ({table[n]})" for n in order) + "\n" + body


def r6(expr: str) -> str:
    return f"case when round({expr}, 6) = 0 then 0.0 else round({expr}, 6) end"


def half_even(expr: str, digits: int) -> str:
    """Decimal rounding of the exact binary value: what a correctly rounded double prints."""
    return f"(format('{{:.{digits}f}}', ({expr})::double)::double + 0.0)"


def t_tail(t: str, dof: str) -> str:
    """P(T > t) for t >= 0 by Boole's rule on the angle atan(t / sqrt(dof))."""
    n = 2000
    top = f"(case when {dof} >= 30 then atan(({t} + 14) / sqrt({dof})) else pi() / 2 end)"
    low = f"atan({t} / sqrt({dof}))"
    step = f"(({top} - {low}) / {n})"
    area = (f"list_sum(list_transform(range(0, {n + 1}), lambda i: "
            f"(case when i = 0 or i = {n} then 7 when i % 2 = 1 then 32 when i % 4 = 2 then 12 else 14 end) "
            f"* pow(cos(least(pi() / 2, {low} + i * {step})), {dof} - 1))) * {step} * 2 / 45")
    # with many degrees of freedom the difference of two large logarithms loses digits; a series in 2 / dof doesn't
    x = f"({dof} / 2.0)"
    series = (f"sqrt({x}) * (1 - 1 / (8 * {x}) + 1 / (128 * pow({x}, 2)) + 5 / (1024 * pow({x}, 3)) "
              f"- 21 / (32768 * pow({x}, 4)) - 399 / (262144 * pow({x}, 5)))")
    const = f"(case when {dof} >= 100 then {series} else exp(lgamma({x} + 0.5) - lgamma({x})) end / sqrt(pi()))"
    return f"(case when {t} = 'inf'::double then 0.0 else {const} * {area} end)"


def z_two_sided(z: str) -> str:
    n = 2000
    area = (f"list_sum(list_transform(range(0, {n + 1}), lambda i: "
            f"(case when i = 0 or i = {n} then 1 when i % 2 = 1 then 4 else 2 end) "
            f"* exp(-0.5 * pow({z} + i * (14.0 / {n}), 2)))) * (14.0 / {n}) / 3")
    return f"(2 * {area} / sqrt(2 * pi()))"


def bh(source: str, family: str, p: str = "p", out: str = "q") -> str:
    """Adjusted p: smallest p * m / rank at or above the row's own rank."""
    part = f"partition by {family}" if family else ""
    return f"""
    select * exclude (rk_, m_), least(1.0, min({p} * m_ / rk_) over ({part} order by rk_
        rows between current row and unbounded following)) as {out}
    from (select *, row_number() over ({part} order by {p}) as rk_,
                 count(*) over ({part}) as m_ from {source})"""


# --- text -------------------------------------------------------------------------------

BLANK = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
LETTER = r"a-z\x{900}-\x{97f}'"
WORD = r"\p{L}\p{N}_"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_quote, values)) + "]" if values else "[]::varchar[]"


def norm(expr: str) -> str:
    out = f"lower(nfc_normalize({expr}))"
    for symbol, word in config.EMOJI_WORDS.items():
        out = f"replace({out}, {_quote(symbol)}, {_quote(word)})"
    spans = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in config.EMOJI_RANGES)
    out = f"regexp_replace({out}, '[{spans}]', ' ', 'g')"
    out = f"trim(regexp_replace({out}, '{BLANK}+', ' ', 'g'))"
    whens = " ".join(f"when w = {_quote(k)} then {_quote(v)}" for k, v in config.SPELLING.items())
    return (f"array_to_string(list_transform(string_split({out}, ' '), "
            f"lambda w: case {whens} else w end), ' ')")


def clauses(expr: str) -> str:
    """list of {clause, turn} of a normalised text (marks: 1 = plain, 2 = contrast)."""
    words = "|".join(config.CONTRAST_WORDS)
    out = f"(' ' || {expr} || ' ')"
    # RE2 has no lookaround: the neighbours are matched and put back, twice for neighbours
    # that two matches share.
    for _ in range(2):
        out = (f"regexp_replace({out}, '([^{LETTER.replace(chr(39), chr(39) * 2)}])({words})"
               f"([^{LETTER.replace(chr(39), chr(39) * 2)}])', '\\1' || chr(64977) || '\\3', 'g')")
    for _ in range(2):
        out = (f"regexp_replace({out}, '([^{WORD}])(or|aur)([^{WORD}])', "
               f"'\\1' || chr(64976) || '\\3', 'g')")
    out = f"regexp_replace({out}, '[.!?;,\\n]', chr(64976), 'g')"
    out = (f"regexp_replace({out}, '[ ' || chr(64976) || ']*' || chr(64977) || '[ ' || chr(64976) "
           f"|| chr(64977) || ']*', chr(64976) || chr(64977), 'g')")
    return (f"list_filter(list_transform(string_split({out}, chr(64976)), lambda c: "
            f"{{'clause': trim(replace(c, chr(64977), '')), 'turn': contains(c, chr(64977))}}), "
            f"lambda s: s.clause <> '')")


def tokens(expr: str) -> str:
    return f"regexp_extract_all({expr}, '[{LETTER.replace(chr(39), chr(39) * 2)}]+')"


def clause_aspects(clause: str, toks: str) -> str:
    parts = []
    for name, cues in TEST_ASPECTS.items():
        whole = [c for c in cues if " " not in c]
        inside = [c for c in cues if " " in c]
        test = f"list_has_any({toks}, {_list(whole)})"
        for c in inside:
            test += f" or contains({clause}, {_quote(c)})"
        parts.append(f"case when {test} then {_quote(name)} end")
    return f"list_filter([{', '.join(parts)}], lambda a: a is not null)"


def clause_score(clause: str, toks: str) -> str:
    lex = TEST_LEXICON
    phrases = " + ".join(
        [f"contains({clause}, {_quote(p)})::int" for p in lex["positive_phrases"]]
        + [f"-(contains({clause}, {_quote(p)})::int)" for p in lex["negative_phrases"]])
    code = (f"case when list_contains({_list(lex['post_negation'])}, t) then 3 "
            f"when list_contains({_list(lex['negation'])}, t) then 2 "
            f"when list_contains({_list(lex['positive'])}, t) then 1 "
            f"when list_contains({_list(lex['negative'])}, t) then -1 else 0 end")
    zero = "{'code': 0, 'score': 0, 'neg': 0, 'gap': 99, 'd': 0}"
    items = (f"list_transform({toks}, lambda t: {{'code': {code}, 'score': 0, 'neg': 0, "
             f"'gap': 99, 'd': 0}})")
    back = "(y.code = 3 and x.d <> 0 and x.gap <= 2)"
    delta = "(case when x.neg > 0 then -y.code else y.code end)"
    fold = (f"list_reduce({items}, lambda x, y: {{'code': 0, "
            f"'score': case when {back} then x.score - 2 * x.d when y.code in (1, -1) "
            f"then x.score + {delta} else x.score end, "
            f"'neg': case when {back} then x.neg when y.code >= 2 then 3 "
            f"else greatest(x.neg - 1, 0) end, "
            f"'gap': case when not {back} and y.code in (1, -1) then 1 else x.gap + 1 end, "
            f"'d': case when {back} then 0 when y.code in (1, -1) then {delta} else x.d end}}, "
            f"{zero}).score")
    return f"sign({fold} + {phrases})::int"


CTES["docs"] = f"""select doc_id as review_id, source as property_id, lang as platform,
    date '2024-01-01' + (doc_id * 7 % 700)::int as date, (1 + doc_id % 5)::double as rating,
    text, lang as language_hint, {norm('text')} as norm from documents"""
CTES["doc_clauses"] = f"""select review_id, property_id, date, pos, c.clause as clause, c.turn as turn,
    {tokens('c.clause')} as toks
    from (select review_id, property_id, date, unnest(cs) as c, unnest(range(0, len(cs))) as pos
          from (select *, {clauses('norm')} as cs from docs))"""
CTES["doc_own"] = f"select *, {clause_aspects('clause', 'toks')} as own from doc_clauses"
CTES["doc_runs"] = """select *, sum(case when turn then 0 else 1 end)
    over (partition by review_id order by pos) as run from doc_own"""
CTES["doc_aspects"] = """select review_id, property_id, date, pos, clause, toks,
    last_value(case when len(own) > 0 then own end ignore nulls)
    over (partition by review_id, run order by pos) as aspects from doc_runs"""
CTES["doc_scored"] = f"""select review_id, property_id, date, pos, clause, aspects,
    {clause_score('clause', 'toks')} as sentiment from doc_aspects where aspects is not null"""
CTES["doc_mentions"] = """select review_id, property_id, date, unnest(aspects) as aspect, sentiment,
    clause as sentence from doc_scored"""

ORACLES["t1_normalise"] = f"select doc_id, {norm('text')} as norm from documents"
ORACLES["t2_clauses"] = f"""select doc_id, pos, c.clause as clause, c.turn as after_contrast from (
    select doc_id, unnest(cs) as c, unnest(range(0, len(cs))) as pos from (
    select doc_id, {clauses(norm("text || ' but however or lekin ' || text"))} as cs
    from documents))"""
ORACLES["t3_sentences"] = f"""select conv_id, turn, pos, c.clause as sentence from (
    select conv_id, turn, unnest(cs) as c, unnest(range(0, len(cs))) as pos from (
    select conv_id, turn, {clauses(norm('text'))} as cs from conversations))"""
ORACLES["t4_tokens"] = f"""select doc_id, len(t)::bigint as n_tokens,
    md5(array_to_string(t, ' ')) as tokens_md5
    from (select doc_id, {tokens(norm('text'))} as t from documents)"""
ORACLES["t5_language"] = f"""select doc_id, case when regexp_matches(text, '[\\x{{900}}-\\x{{97f}}]')
    then 'hi' when {' or '.join(f"contains(lower(text), '{m}')" for m in config.HINGLISH_MARKERS)}
    then 'hinglish' else 'en' end as hint from documents"""
ORACLES["t7_clause_aspects"] = _sql("""select review_id, clause,
    array_to_string(aspects, ';') as aspects from doc_aspects where aspects is not null""")
ORACLES["st1_label_stream"] = _sql("""select review_id, aspect, null::varchar as rejected, count(*) as n
    from doc_mentions group by review_id, aspect union all
    select doc_id, null, 'empty text', 1 from documents where coalesce(text, '') = ''""")
ORACLES["t9_label_reviews"] = _sql("select * from doc_mentions")
_BY_LENGTH = """select review_id, property_id, date, unnest(aspects) as aspect,
    (length(clause) % 3 - 1)::int as sentiment, clause as sentence from doc_aspects
    where aspects is not null"""
ORACLES["t10_hybrid_sentiment"] = _sql(_BY_LENGTH)
ORACLES["t11_batch_scorer"] = _sql(_BY_LENGTH)

# --- ingestion ----------------------------------------------------------------------------

CTES["overlapping"] = """select doc_id, lang, text, 1 + n_chars % 5 as rating,
    (doc_id % 4)::int as file_no from documents"""
ORACLES["i4_cross_file_repeats"] = _sql("""select doc_id, file_no from (select *,
    min(file_no) over (partition by lang, text, rating) as first_no from overlapping)
    where file_no = first_no""")
ORACLES["i5_drop_identity"] = "select doc_id, lang as language_hint from documents"
ORACLES["i6_split_valid"] = """select doc_id as review_id,
    case when doc_id % 17 = 0 then 'non-numeric rating'
    when doc_id % 7 not between 1 and 5 then 'rating out of range'
    when doc_id % 13 = 0 then 'empty text' else 'ok' end as reason from documents"""
ORACLES["i7_parse_layout"] = """select o_orderkey, o_orderdate::timestamp + case o_orderkey % 3
    when 0 then interval 330 minute else interval 0 minute end as date from orders"""
ORACLES["i7_parse_epoch"] = """select o_orderkey,
    date_trunc('second', o_orderdate) + interval 330 minute as date from orders"""
ORACLES["i8_map_columns"] = """select source as property_id, lang as platform,
    '2024-01-05' as date, 1 + doc_id % 5 as rating, text, lang as language_hint,
    doc_id as review_id from documents"""
ORACLES["i1_read_json"] = "select doc_id, lang, source, n_chars, md5(text) as text_md5 from documents"
_EXPORTED = f"""select doc_id::varchar as review_id, coalesce(source, 'none') as property_id, coalesce(lang, 'none') as platform,
    date '2024-01-01' + (doc_id * 7 % 700)::int as date, (1 + doc_id % 5)::double as rating,
    md5(case when text is null or regexp_full_match(text, '{BLANK}*') then '(no text)' else text end) as text_md5, 7 as n_columns from documents"""
ORACLES["i2_load_reviews"] = _EXPORTED
ORACLES["i3_load_dir"] = _EXPORTED
ORACLES["i9_adapt_export"] = _EXPORTED
ORACLES["i10_assign_ids"] = """select lang as property_id, count(*) as n, count(*) as n_ids
    from documents group by 1"""
ORACLES["i11_property_ids"] = "select s_suppkey, trim(s_name) as property_id from supplier"
ORACLES["i12_load_cluster"] = _sql("""select property_id, aspect, count(*) as n,
    sum(sentiment)::bigint as total from doc_mentions group by all""")
ORACLES["i13_region_reviews"] = _sql("""select md5(text) as text_md5, stars,
    case when stars <= 2 then -1 when stars = 3 then 0 else 1 end as label,
    'H' || sha256(stem)[:8] as hotel,
    case k when 0 then 'Mussoorie' when 1 then 'Pauri Garhwal' else 'Old Manali' end as town,
    case k when 0 then 'Dehradun' when 1 then 'Pauri Garhwal' else 'Kullu' end as district,
    case k when 3 then 'Himachal Pradesh' else 'Uttarakhand' end as state
    from (select *, row_number() over (partition by norm order by stem, review_id) as rn from (
        select review_id, text, norm, (review_id % 4)::int as k, (review_id % 6 + 1)::int as stars,
        case review_id % 4 when 0 then 'Hill_Inn-Mussoorie_Dehradun_District_Uttarakhand'
        when 1 then 'Lake_Inn-Pauri_Garhwal_District_Uttarakhan'
        else 'Snow-View-Old_Manali_Kullu_District_Himachal_Pradesh' end as stem
        from docs where review_id % 4 <> 2 and review_id % 6 < 5 and regexp_matches(text, '\\S')))
    where rn = 1""")
ORACLES["i14_clean_social"] = f"""select conv_id, turn, trim(regexp_replace(regexp_replace(
    regexp_replace('@ ' || role || ' ' || text || '  https : / / t . co / abc rest',
    'https? : / / \\S+(?: [./] \\S+)*', ' ', 'g'), '@ \\S+', ' ', 'g'), '{BLANK}+', ' ', 'g'))
    as clean from conversations"""

# --- mentions, units, scores ------------------------------------------------------------------

_SENT = "case when l_quantity < 17 then -1 when l_quantity < 34 then 0 else 1 end"
CTES["mentions_li"] = f"""select l_orderkey as review_id, 'S' || l_suppkey as property_id,
    l_shipdate::date as date, l_returnflag || l_linestatus as aspect, {_SENT} as sentiment
    from lineitem"""
CTES["lines_nation"] = f"""select l_orderkey * 100000 + year(l_shipdate) * 12 + month(l_shipdate)
    as review_id, s_nationkey as nation, l_shipdate::date as date,
    l_returnflag || l_linestatus as aspect, {_SENT} as sentiment
    from lineitem join supplier on l_suppkey = s_suppkey"""
CTES["mentions_planted"] = """select review_id, 'N' || nation as property_id, nation, date, aspect,
    case when (aspect = 'RF' and nation = 7 and date >= date '1999-06-01')
      or (aspect = 'AO' and month(date) = 12)
      or (aspect = 'NO' and nation in (8, 10, 12, 23) and date >= date '1999-03-01')
      or (aspect = 'NF' and date >= date '1998-07-01') then -1 else sentiment end as sentiment,
    'all' as cluster_id from lines_nation"""
CTES["mentions_region"] = """select m.* exclude (cluster_id), 'R' || n_regionkey as cluster_id
    from mentions_planted m join nation on nation = n_nationkey"""
CTES["mentions"] = "select * from mentions_planted"
CTES["units_li"] = """select review_id, property_id, aspect, min(date) as date,
    sum(sentiment)::bigint as total, count(*) as mentions,
    sum(sentiment) / count(*) as value from mentions_li group by all"""
CTES["scores_li"] = """select property_id, aspect, avg(sentiment) as mean, count(sentiment) as n
    from mentions_li group by all"""
CTES["cmeans_li"] = "select aspect, avg(mean) as cluster_mean from scores_li group by all"

ORACLES["a1_review_units"] = _sql(f"""select review_id, property_id, aspect, date, total, mentions,
    {r6('value')} as value from units_li""")
ORACLES["a1_unit_cells"] = _sql("""select property_id, aspect,
    date_trunc('month', date)::date as month, total, mentions, count(*) as r
    from units_li group by all""")
ORACLES["a1_units_from_arrays"] = _sql(f"""select review_id, property_id, date, aspect,
    sum(sentiment)::bigint as total, count(*) as mentions,
    {r6('sum(sentiment) / count(*)')} as value from doc_mentions group by all""")
ORACLES["a2_aspect_scores"] = _sql(f"""select property_id, aspect, {r6('mean')} as mean, n
    from scores_li""")
ORACLES["a3_cluster_means"] = _sql(f"""select aspect, {r6('cluster_mean')} as cluster_mean
    from cmeans_li""")
ORACLES["a3_gap_to_cluster"] = _sql(f"""select property_id, aspect, {r6('mean')} as mean, n,
    {r6('cluster_mean')} as cluster_mean, {r6('mean - cluster_mean')} as diff
    from scores_li join cmeans_li using (aspect)""")
ORACLES["a4_trend"] = _sql(f"""select property_id, aspect, date_trunc('month', date)::date as month,
    {r6('avg(sentiment)')} as mean, count(*) as n from mentions_li group by 1, 2, 3""")
ORACLES["a5_matrix"] = _sql("select property_id, " + ", ".join(
    r6(f"avg(case when aspect = '{a}' then sentiment end)") + f' as "{a}"'
    for a in ("AF", "AO", "NF", "NO", "RF", "RO")) + " from mentions_li group by 1")
ORACLES["a6_mean_since"] = _sql(f"""select aspect, {r6('avg(mean)')} as mean_since from (
    select property_id, aspect, avg(sentiment) as mean from mentions_li
    where date >= date '1998-01-01' group by all) group by 1""")
ORACLES["a7_star_averages"] = f"""select source as property_id,
    {r6('avg(1 + doc_id % 5)')} as mean_rating, count(*) as n from documents group by 1"""
ORACLES["a8_properties"] = _sql("""select distinct property_id,
    's' || lpad(substr(property_id, 2), 20, '0') as sort_key from mentions_li""")
ORACLES["a8_date_range"] = """select min(l_shipdate)::date as date_min, max(l_shipdate)::date
    as date_max from lineitem"""
ORACLES["a9_coverage"] = _sql("""select aspect, count(distinct property_id) as n_properties
    from mentions_li group by 1""")

# --- benchmark -----------------------------------------------------------------------------------

CTES["units"] = """select cluster_id, review_id, property_id, aspect, min(date) as date,
    sum(sentiment)::bigint as total, count(*) as mentions, sum(sentiment) / count(*) as value
    from mentions group by cluster_id, review_id, property_id, aspect"""
CTES["scores"] = """select cluster_id, property_id, aspect, avg(sentiment) as mean, count(*) as n
    from mentions group by all"""
CTES["robust"] = """select cluster_id, property_id, aspect, count(*) as n_reviews,
    sum(pow(total - mean * mentions, 2)) as dev2, sum(mentions) as m
    from units join scores using (cluster_id, property_id, aspect) group by all"""
CTES["profile"] = """select s.*, n_reviews::bigint as n_reviews, avg(mean) over
    (partition by s.cluster_id, aspect) as cluster_mean,
    case when n_reviews >= 2 then sqrt(n_reviews / (n_reviews - 1)
      * case when dev2 < 1e-9 then 0 else dev2 end) / m end as se
    from scores s join robust using (cluster_id, property_id, aspect)"""
CTES["z_tests"] = f"""select *, mean - cluster_mean as diff, case when n_reviews < 10 or se is null
    then null when se = 0 then case when mean = cluster_mean then 1.0 else 0.0 end
    else {z_two_sided('(abs(mean - cluster_mean) / se)')} end as p from profile"""
CTES["z_eligible"] = "select * from z_tests where p is not null"
CTES["z_judged"] = bh("z_eligible", "cluster_id")
ORACLES["b1_robust_se"] = _sql(f"""select property_id, aspect, n_reviews, n, {r6('mean')} as mean,
    {r6('se')} as se from profile""")
ORACLES["b2_p_values"] = _sql(f"""select property_id, aspect, n_reviews, n, {r6('mean')} as mean,
    {r6('se')} as se, {r6('cluster_mean')} as cluster_mean, {r6('diff')} as diff,
    {r6('p')} as p_value from z_tests""")
for _name, _base, _key in (("b5_benchmark_tests", None, ""),
                           ("b5_benchmark_by_region", "mentions_region", "cluster_id, ")):
    ORACLES[_name] = _sql(f"""select {_key}property_id, aspect, t.n_reviews, t.n,
    {r6('t.mean')} as mean, {r6('t.cluster_mean')} as cluster_mean, {r6('t.diff')} as diff,
    {r6('t.p')} as p_value, {r6('j.q')} as q_value from z_tests t
    left join (select cluster_id, property_id, aspect, q from z_judged) j
    using (cluster_id, property_id, aspect)""", _base)
CTES["line_p"] = """select l_orderkey, l_linenumber, l_returnflag as family,
    least(l_extendedprice * l_tax / 8191.0, 1.0) as p from lineitem"""
CTES["line_q"] = bh("line_p", "family")
ORACLES["b3_q_values"] = ORACLES["b3_q_values_bucketed"] = _sql(f"""select l_orderkey,
    l_linenumber, family, {r6('p')} as p_value, {r6('q')} as q_value from line_q""")

# --- changepoints ------------------------------------------------------------------------------------

CTES["unit_months"] = """select *, date_trunc('month', date)::date as month from units"""
CTES["monthly"] = """select cluster_id, property_id, aspect, month, count(*) as n,
    sum(value) as s, sum(value * value) as ss from unit_months
    group by cluster_id, property_id, aspect, month"""
CTES["own"] = """select cluster_id, property_id, aspect, count(*) as n_pa, avg(value) as alpha,
    coalesce(var_samp(value), 0) * (count(*) - 1) as ssw from units group by all"""
CTES["levels"] = """select *, coalesce(case when dall > n_pa - 1 then (wall - ssw)
    / (dall - (n_pa - 1)) end, 1.0) as v_loo, kprop from (select *,
    sum(ssw) over (partition by cluster_id, aspect) as wall,
    sum(n_pa - 1) over (partition by cluster_id, aspect) as dall,
    count(*) over (partition by cluster_id, aspect) as kprop from own)"""
CTES["centred"] = """select m.*, alpha, v_loo, kprop, s - n * alpha as c from monthly m
    join levels using (cluster_id, property_id, aspect)"""
CTES["loo"] = """select *, sum(n) over w - n as on_, sum(c) over w - c as oc from centred
    window w as (partition by cluster_id, aspect, month)"""
CTES["market_months"] = """select cluster_id, property_id, aspect, month, n, s, ss,
    kprop >= 3 as residual, case when kprop >= 3 then oc / on_ else 0.0 end as market,
    case when kprop >= 3 then v_loo / on_ else 0.0 end as mvar
    from loo where kprop < 3 or on_ > 0"""
CTES["adjusted"] = """select *, s - n * market as rs, ss - 2 * market * s + n * market * market
    as rss from market_months"""


def _splits(source: str, keys: str) -> str:
    """Both sides of every split of each series, from cumulative sums."""
    return f"""select *, m2 - m1 as delta, raw2 / n2 - raw1 / n1 as raw_delta,
    (nt - 2)::double as dof, sqrt(greatest(ss1 - n1 * m1 * m1, 0) / (nt - 2) * (1.0 / n1 + 1.0 / n2)
      + greatest(ss2 - n2 * m2 * m2, 0) / (nt - 2) * (1.0 / n1 + 1.0 / n2)
      + mk1 / (n1 * n1) + mk2 / (n2 * n2)) as se
    from (select *, s1 / n1 as m1, s2 / n2 as m2 from (select *,
      count(*) over b as k, count(*) over a as months, sum(n) over a as nt,
      sum(n) over b as n1, sum(n) over a - sum(n) over b as n2,
      sum(rs) over b as s1, sum(rs) over a - sum(rs) over b as s2,
      sum(rss) over b as ss1, sum(rss) over a - sum(rss) over b as ss2,
      sum(s) over b as raw1, sum(s) over a - sum(s) over b as raw2,
      sum(n * n * mvar) over b as mk1,
      sum(n * n * mvar) over a - sum(n * n * mvar) over b as mk2
      from {source} window a as (partition by {keys}),
      b as (partition by {keys} order by month rows between unbounded preceding and 1 preceding))
    where n1 > 0 and n2 > 0)"""


def _best(source: str, keys: str, min_months: int = 4, min_units: int = 10) -> str:
    """The admissible split with the largest abs(t), earliest on ties, and its p."""
    return f"""select * exclude (rn_), least(1.0, n_splits * 2 * {t_tail('abs(t)', 'dof')}) as p
    from (select *, row_number() over (partition by {keys} order by abs(t) desc, month) as rn_,
      count(*) over (partition by {keys}) as n_splits from (
      select *, case when se > 1e-9 then delta / se when delta <> 0
        then 'inf'::double * sign(delta) else 0 end as t from {source}
      where k >= {min_months} and months - k >= {min_months} and n1 >= {min_units}
        and n2 >= {min_units}))
    where rn_ = 1"""


_SERIES = "cluster_id, property_id, aspect"
CTES["splits"] = _splits("adjusted", _SERIES)
CTES["best"] = _best("splits", _SERIES)
CTES["best_judged"] = bh("best", "cluster_id")
CTES["shifts_found"] = f"""select *, strftime(month, '%Y-%m') as change_month,
    {half_even('delta', 3)} as delta3, {half_even('raw_delta', 3)} as raw3,
    case when residual then {half_even('raw_delta - delta', 3)} end as market3
    from best_judged where q <= 0.05 and abs(delta) >= 0.4"""
ORACLES["c1_own_levels"] = _sql(f"""select property_id, aspect, {r6('alpha')} as alpha,
    {r6('v_loo')} as v_loo from levels""")
ORACLES["c2_market_months"] = _sql(f"""select property_id, aspect, month, n, residual, {', '.join(
    f"{r6(c)} as {c}" for c in ('s', 'ss', 'market', 'mvar', 'rs', 'rss'))} from adjusted""")
ORACLES["c3_split_statistics"] = _sql(f"""select property_id, aspect, month, k, n1::bigint as n1,
    n2::bigint as n2, dof, {', '.join(f"{r6(c)} as {c}" for c in ('delta', 'raw_delta', 'se'))}
    from splits""")
ORACLES["c5_best_split"] = _sql(f"""select property_id, aspect, n_splits, month, n1::bigint as n1,
    n2::bigint as n2, dof, {', '.join(f"{r6(c)} as {c}" for c in
    ('delta', 'raw_delta', 'se', 't'))}, {r6('p')} as p_value from best""")
for _name, _base, _key in (("c6_changepoints", None, ""),
                           ("c6_changepoints_by_region", "mentions_region", "cluster_id, ")):
    ORACLES[_name] = _sql(f"""select {_key}property_id, aspect, change_month, delta3 as delta,
    case when delta < 0 then 'negative' else 'positive' end as direction, raw3 as raw_delta,
    market3 as market_delta, {r6('p')} as p_value, {r6('q')} as q_value from shifts_found""",
                           _base)
ORACLES["c7_shift_at"] = _sql(f"""select property_id, aspect, n1, n2, {r6('delta')} as delta,
    {r6('raw_delta')} as raw_delta, dof,
    {r6('sqrt(within / dof * (1.0 / n1 + 1.0 / n2) + mk1 / n1 / n1 + mk2 / n2 / n2)')} as se
    from (select *, s2 / n2 - s1 / n1 as delta, raw2 / n2 - raw1 / n1 as raw_delta,
      (n1 + n2 - 2)::double as dof, greatest(ss1 - s1 * s1 / n1, 0)
      + greatest(ss2 - s2 * s2 / n2, 0) as within
    from (select property_id, aspect, {', '.join(
        f"coalesce(sum({e}) filter (month {op} date '1999-06-01'), 0){cast} as {name}{i}"
        for name, e, cast in (('n', 'n', '::bigint'), ('s', 'rs', ''), ('ss', 'rss', ''),
                              ('raw', 's', ''), ('mk', 'n * n * mvar', ''))
        for i, op in ((1, '<'), (2, '>=')))} from adjusted group by 1, 2)
    where n1 >= 1 and n2 >= 1 and n1 + n2 >= 3)""")

# --- market patterns -----------------------------------------------------------------------------------


def t_upper(t: str, dof: str) -> str:
    return (f"(case when {t} >= 0 then {t_tail(f'abs({t})', dof)} "
            f"else 1 - {t_tail(f'abs({t})', dof)} end)")


CTES["wide"] = """select *, count(*) over () as unused_ from (select m.*, coverage from monthly m
    join (select cluster_id, aspect, count(distinct property_id) as coverage from monthly
          group by all) using (cluster_id, aspect)) where coverage >= 3"""
CTES["gaps"] = """select property_id, aspect, yr, cal, (sy - s) / (ny - n) - s / n as gap from (
    select *, sum(n) over y as ny, sum(s) over y as sy from (
      select *, year(month) as yr, month(month) as cal from wide)
    window y as (partition by property_id, aspect, yr))
    where n >= 2 and ny - n >= 5"""
CTES["yearly"] = """select *, case when sd_gap > 1e-12 then mean_gap / (sd_gap / sqrt(k))
    when mean_gap > 0 then 'inf'::double else '-inf'::double end as t, (k - 1)::double as dof from (
    select aspect, cal, yr, count(*) as k, avg(gap) as mean_gap, stddev_samp(gap) as sd_gap
    from gaps group by all) where k >= 3"""
CTES["by_property"] = """select aspect, cal, property_id, avg(gap) as gap, min(gap) as worst,
    avg(gap) >= 0.3 and min(gap) > 0 as joins_ from gaps group by all having count(*) >= 2"""
CTES["seasonal"] = f"""select * from (select aspect, cal, count(*) as years, max({t_upper('t', 'dof')}) as p
    from yearly group by all having count(*) >= 2) join (
    select aspect, cal, avg(gap) as fall, count(*) as n_tested, count_if(joins_) as n_participating
    from by_property group by all) using (aspect, cal)"""
CTES["seasonal_q"] = bh("seasonal", "")
CTES["coverages"] = "select distinct aspect, coverage from wide"
CTES["seasonal_kept"] = """select * from seasonal_q join coverages using (aspect)
    where q <= 0.05 and n_participating / coverage >= 0.6"""
CTES["masked"] = """select w.* from wide w where not exists (select 1 from seasonal_kept k
    where k.aspect = w.aspect and k.cal = month(w.month))"""
CTES["grid"] = """select aspect, month, row_number() over (partition by aspect order by month) - 1 as pos,
    count(*) over (partition by aspect) as grid_size from (select distinct aspect, month from wide)"""


def _steps(source: str) -> str:
    """Dense property x month grid, every split, properties with five units throughout."""
    return f"""select property_id, aspect, pos as split, grid_size, s2 / n2 - s1 / n1 as d from (
    select *, bool_and(n1 >= 5 and n2 >= 5) over (partition by property_id, aspect) as ok from (
      select p.property_id, aspect, g.pos, grid_size,
        sum(coalesce(n, 0)) over b as n1, sum(coalesce(n, 0)) over a - sum(coalesce(n, 0)) over b as n2,
        sum(coalesce(s, 0)) over b as s1, sum(coalesce(s, 0)) over a - sum(coalesce(s, 0)) over b as s2
      from (select distinct property_id, aspect from {source}) p join grid g using (aspect)
      left join {source} m using (property_id, aspect, month)
      window a as (partition by p.property_id, aspect), b as (partition by p.property_id, aspect
        order by g.pos rows between unbounded preceding and 1 preceding))
    where pos between 4 and grid_size - 4) where ok"""


def _step_tests(source: str) -> str:
    return f"""select *, case when sd > 1e-12 then fall / (sd / sqrt(n_tested))
    when fall > 0 then 'inf'::double else '-inf'::double end as t, (n_tested - 1)::double as dof from (
    select aspect, split, count(*) as n_tested, -avg(d) as fall, stddev_samp(d) as sd,
      count_if(d <= -0.3) as n_participating, (max(grid_size) - 7)::bigint as n_splits,
      row_number() over (partition by aspect order by -avg(d) desc, split) as rn_
    from {source} group by aspect, split having count(*) >= 3) where rn_ = 1"""


CTES["steps_all"] = _steps("wide")
CTES["steps_all_tests"] = _step_tests("steps_all")
CTES["steps"] = _steps("masked")
CTES["step_tests"] = _step_tests("steps")
CTES["step_p"] = f"""select *, least(1.0, n_splits * {t_upper('t', 'dof')}) as p from step_tests"""
CTES["step_q"] = bh("step_p", "")
CTES["step_kept"] = """select k.*, coverage, strftime(month, '%Y-%m') as change_month
    from step_q k join coverages using (aspect) join grid g on g.aspect = k.aspect and pos = split
    where q <= 0.05 and n_participating / coverage >= 0.6"""
CTES["findings"] = f"""select aspect, 'seasonal' as kind, cal::int as calendar_month,
    null::varchar as change_month, {half_even('fall', 3)} as fall, n_tested, n_participating, coverage,
    p, q from seasonal_kept
    union all select aspect, 'step', null, change_month, {half_even('fall', 3)}, n_tested,
    n_participating, coverage, p, q from step_kept"""
CTES["participants"] = """select aspect, 'seasonal' as kind, cal::int as calendar_month,
    null::varchar as change_month, property_id, b.gap, q from by_property b
    join seasonal_kept using (aspect, cal) where joins_
    union all select aspect, 'step', null, change_month, property_id, -d, q from steps
    join step_kept using (aspect, split) where d <= -0.3"""
_TOLD = f"""case when kind = 'seasonal' then 'seasonal dip in ' || {_list(config.MONTH_NAMES)}[calendar_month]
    else 'decline from ' || change_month end || ' (' || n_participating || '/' || coverage
    || ' properties, average drop ' || printf('%.2f', fall) || ')'"""
ORACLES["m1_seasonal_gaps"] = _sql(f"""select property_id, aspect, yr as year, cal,
    {r6('gap')} as gap from gaps""")
ORACLES["m2_year_tests"] = _sql(f"""select aspect, cal, yr as year, k, {r6('mean_gap')} as mean_gap,
    {r6('sd_gap')} as sd_gap, {r6('t')} as t from yearly""")
ORACLES["m3_seasonal_tests"] = _sql(f"""select aspect, cal, years, {r6('p')} as p_value,
    {r6('fall')} as "drop", n_tested, n_participating from seasonal""")
ORACLES["m4_step_shifts"] = _sql(f"""select property_id, aspect, split, grid_size, {r6('d')} as d
    from steps_all""")
ORACLES["m4_step_tests"] = _sql(f"""select aspect, split, n_tested, n_participating, n_splits,
    {r6('fall')} as "drop", {r6('t')} as t from steps_all_tests""")
ORACLES["m6_market_findings"] = _sql(f"""select aspect, kind, calendar_month, change_month,
    fall as "drop", n_tested, n_participating, coverage, {r6('p')} as p_value, {r6('q')} as q_value
    from findings""")
ORACLES["m7_market_patterns"] = _sql(f"""select f.aspect, f.kind, f.calendar_month, f.change_month,
    fall as "drop", n_tested, n_participating, {half_even('n_participating / coverage', 3)} as share,
    (select string_agg(property_id, ', ' order by property_id) from participants x
     where x.aspect = f.aspect and x.kind = f.kind
     and x.calendar_month is not distinct from f.calendar_month) as properties,
    {r6('p')} as p_value, {r6('q')} as q_value from findings f""")
ORACLES["m8_seasonal_dips"] = _sql(f"""select property_id, aspect, calendar_month as target_month,
    {half_even('gap', 3)} as gap, {r6('q')} as q_value from participants where kind = 'seasonal'""")
ORACLES["m9_describe"] = _sql(f"select aspect, kind, {_TOLD} as sentence from findings")

# --- space ------------------------------------------------------------------------------------------------


def km(a: str, b: str) -> str:
    return (f"2 * {config.EARTH_RADIUS_KM} * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) "
            f"+ cos(radians({a}.lat)) * cos(radians({b}.lat)) "
            f"* pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))")


CTES["places"] = """select 'N' || k as property_id, 30.445::double + (k * 37 % 100) * 0.00023::double as lat,
    78.03::double + (k * 53 % 100) * 0.0007::double as lon, 'Z' || (k % 5) as zone
    from (select distinct s_nationkey as k from supplier)"""
CTES["pairs"] = f"""select a.property_id, b.property_id as other_id, {km('a', 'b')} as km
    from places a, places b"""
CTES["groups"] = """select distinct members from (select property_id,
    list_sort(list(other_id)) as members from pairs where km <= 1.0 group by 1)
    where len(members) between 3 and (select floor(count(*) * 0.5) from places)"""
ORACLES["g1_location_checks"] = """with h as (select 'H' || (s_suppkey % 90) as property_id,
    s_suppkey % 9 = 0 or s_suppkey % 11 = 0 as bad from supplier)
    select property_id, 'invalid coordinates' as problem from h where bad
    union all select property_id, 'more than one position' from h group by 1 having count(*) > 1"""
ORACLES["g2_distances"] = _sql(f"""select a.property_id, {r6(km('a', 'b'))} as km from places a,
    (select 30.455::double as lat, 78.06::double as lon) b""")
ORACLES["g3_neighbours"] = _sql(f"""select property_id, other_id, {r6('km')} as km from pairs
    where km <= 1.0""")
ORACLES["g4_nearest"] = _sql(f"""select property_id, other_id, {r6('km')} as km, rank from (
    select *, row_number() over (partition by property_id order by km, other_id) as rank from pairs
    where property_id <> other_id) where rank <= 3""")
ORACLES["g5_coarsen"] = _sql("""select property_id,
    round_even((floor(lat / dlat) + 0.5) * dlat, 5) as lat,
    round_even((floor(lon / dlon) + 0.5) * dlon, 5) as lon, zone from (select *,
    0.5::double / 111.2 as dlat, 0.5::double / (111.2 * cos(radians(avg(lat) over ()))) as dlon
    from places)""")
ORACLES["g6_groups"] = _sql("""select len(members) as size, array_to_string(members, ', ') as members
    from groups""")
CTES["sums"] = """select property_id, aspect, month, n, c, ss - 2 * alpha * s + n * alpha * alpha as cc
    from centred"""
CTES["all_sums"] = """select aspect, month, sum(n) as n_all, sum(c) as c_all, sum(cc) as cc_all
    from sums group by all"""
ORACLES["g7_centred_sums"] = _sql(f"""select property_id, aspect, month, n, {r6('c')} as c,
    {r6('cc')} as cc from sums""")


def _outside(source: str, keys: str) -> str:
    return f"""select {keys}, month, n_in as n, c_in - n_in * market as rs, c_in - n_in * market as s,
    cc_in - 2 * market * c_in + n_in * market * market as rss,
    greatest(case when sum(n_out) over w > count(*) over w then
      (sum(cc_out) over w - sum(c_out * c_out / n_out) over w) / (sum(n_out) over w - count(*) over w)
      else 1.0 end, 1e-9) / n_out as mvar
    from (select *, c_out / n_out as market from (select *, n_all - n_in as n_out,
      c_all - c_in as c_out, cc_all - cc_in as cc_out from {source} join all_sums using (aspect, month))
      where n_in > 0 and n_out > 0) window w as (partition by {keys})"""


CTES["group_in"] = """select members, aspect, month, sum(n) as n_in, sum(c) as c_in, sum(cc) as cc_in
    from (select members, unnest(members) as property_id from groups) join sums using (property_id)
    group by all"""
CTES["group_adj"] = _outside("group_in", "members, aspect")
CTES["group_splits"] = _splits("group_adj", "members, aspect")
CTES["group_best"] = _best("group_splits", "members, aspect")
CTES["loo_in"] = """select members, x.property_id, aspect, month, n_in - coalesce(n, 0) as n_in,
    c_in - coalesce(c, 0) as c_in, cc_in - coalesce(cc, 0) as cc_in
    from group_in join (select members, unnest(members) as property_id from groups) x using (members)
    left join sums using (property_id, aspect, month)"""
CTES["loo_adj"] = _outside("loo_in", "members, property_id, aspect")
CTES["loo_splits"] = _splits("loo_adj", "members, property_id, aspect")
CTES["loo_best"] = _best("loo_splits", "members, property_id, aspect")
ORACLES["g8_group_tests"] = _sql(f"""select array_to_string(members, ', ') as members, aspect, month,
    n_splits, n1::bigint as n1, n2::bigint as n2, {r6('delta')} as delta, {r6('se')} as se,
    {r6('p')} as p_value from group_best""")
ORACLES["g9_robust_scores"] = _sql(f"""select b.aspect, b.month, len(b.members) as size,
    {r6('b.delta')} as delta, {r6('l.score')} as score from group_best b join (
    select members, aspect, min(case when delta < 0 then -log10(greatest(p, 1e-300)) else 0 end) as score,
      count(*) as tried from loo_best group by all) l using (members, aspect)
    where b.delta < 0 and tried = len(b.members) and score > 0""")

# --- fix checks ---------------------------------------------------------------------------------------------

CTES["starts"] = """select property_id, aspect, unnest(generate_series(lo, hi, interval 1 month))::date as start
    from (select distinct property_id, aspect from adjusted),
    (select min(month) + interval 1 month as lo, max(month)::timestamp as hi from monthly)"""
CTES["past"] = """select a.*, start from adjusted a join starts using (property_id, aspect)
    where month < start"""
CTES["past_splits"] = _splits("past", "property_id, aspect, start")
CTES["past_best"] = _best("past_splits", "property_id, aspect, start")
CTES["first_months"] = """select property_id, aspect, min(month) as first_month,
    bool_or(residual) as has_market from adjusted group by all"""
CTES["baselines"] = """select s.property_id, s.aspect, s.start, has_market, coalesce(b.month,
    case when first_month < s.start then first_month else s.start end) as baseline
    from starts s join first_months using (property_id, aspect) left join (
    select property_id, aspect, start, month from past_best where p <= 0.05 and abs(delta) >= 0.4) b
    using (property_id, aspect, start)"""
ORACLES["f1_baselines"] = _sql("select property_id, aspect, start, baseline from baselines")


def _shift_rows(tests: str) -> str:
    """Both sides of every (aspect, start, baseline) at every property."""
    cols = ", ".join(
        f"coalesce(sum({e}) filter (month {op} start), 0) as {name}{i}"
        for name, e in (("n", "n"), ("s", "rs"), ("ss", "rss"), ("raw", "s"), ("mk", "n * n * mvar"),
                        ("mo", "1"))
        for i, op in ((1, "<"), (2, ">=")))
    return f"""select property_id, aspect, start, baseline, {cols} from adjusted
    join (select distinct aspect, start, baseline from {tests}) using (aspect)
    where month >= baseline group by property_id, aspect, start, baseline"""


def _shifts(rows: str) -> str:
    return f"""select *, count(*) over (g order by abs(delta) desc range unbounded preceding) as rnk,
    count(*) over g as members_ from (select *, s2 / n2 - s1 / n1 as delta,
      raw2 / n2 - raw1 / n1 as raw_delta, (n1 + n2 - 2)::double as dof,
      sqrt((greatest(ss1 - s1 * s1 / n1, 0) + greatest(ss2 - s2 * s2 / n2, 0)) / (n1 + n2 - 2)
        * (1.0 / n1 + 1.0 / n2) + mk1 / (n1 * n1) + mk2 / (n2 * n2)) as se
    from {rows} where n1 >= 10 and n2 >= 10)
    window g as (partition by aspect, start, baseline)"""


CTES["one_test"] = """select distinct aspect, date '1999-06-01' as start, date '1995-01-01' as baseline
    from adjusted"""
CTES["one_rows"] = _shift_rows("one_test")
CTES["one_shifts"] = _shifts("one_rows")
ORACLES["f3_placebo_ranks"] = _sql(f"""select property_id, aspect, {r6('delta')} as delta, rnk as rank,
    members_ - 1 as n_placebo from one_shifts""")
CTES["from_start"] = "select * from adjusted where month >= date '1995-01-01'"
CTES["from_start_splits"] = _splits("from_start", "property_id, aspect")
CTES["from_start_best"] = _best("from_start_splits", "property_id, aspect", 2, 10)
ORACLES["f4_detected_starts"] = _sql("""select property_id, aspect,
    strftime(month, '%Y-%m') as detected_start from from_start_best where p <= 0.05""")
CTES["grid_rows"] = _shift_rows("baselines")
CTES["grid_shifts"] = _shifts("grid_rows")
CTES["windows"] = """select a.*, baseline from adjusted a join (select distinct property_id, aspect, baseline
    from baselines) using (property_id, aspect) where month >= baseline"""
CTES["window_splits"] = _splits("windows", "property_id, aspect, baseline")
CTES["window_best"] = _best("window_splits", "property_id, aspect, baseline", 2, 10)
CTES["grid_checks"] = f"""select b.*, coalesce(r.n1, 0)::bigint as n_before, coalesce(r.n2, 0)::bigint as n_after,
    coalesce(r.mo1, 0)::bigint as months_before, coalesce(r.mo2, 0)::bigint as months_after,
    g.delta, g.raw_delta, g.se, g.dof, g.rnk, g.members_, g.raw1 / g.n1 as before_mean,
    g.raw2 / g.n2 as after_mean, case when g.delta is not null then
    least(1.0, 2 * {t_tail('(abs(g.delta) / g.se)', 'g.dof')}) end as p,
    strftime(w.month, '%Y-%m') as detected from baselines b
    left join grid_rows r using (property_id, aspect, start, baseline)
    left join grid_shifts g using (property_id, aspect, start, baseline)
    left join (select property_id, aspect, baseline, month from window_best where p <= 0.05) w
    using (property_id, aspect, baseline)"""
ORACLES["f6_fix_check_grid"] = _sql(f"""select property_id, aspect, strftime(start, '%Y-%m') as start,
    strftime(baseline, '%Y-%m') as baseline_start, case when n_before < 10 then 'no data'
      when n_after < 10 then 'too early to tell' when p <= 0.05 then
      case when delta > 0 then 'improved' else 'worsened' end else 'no detectable change' end as verdict,
    case when has_market then 'market' else 'own history' end as basis,
    {half_even('delta', 3)} as effect, {r6('p')} as p_value, {half_even('raw_delta', 3)} as naive_delta,
    case when has_market then {half_even('raw_delta - delta', 3)} end as market_delta,
    {half_even('before_mean', 3)} as before_mean, {half_even('after_mean', 3)} as after_mean,
    n_before, n_after, months_before, months_after, {half_even(f'{config.POWER_Z} * se', 3)} as mde,
    case when has_market and members_ > 1 then rnk end as placebo_rank,
    case when has_market and delta is not null then members_ - 1 else 0 end as n_placebo,
    case when delta is not null then detected end as detected_start from grid_checks""")

ORACLES["f2_single_check"] = f"""select * from ({ORACLES['f6_fix_check_grid']})
    where property_id = 'N7' and aspect = 'RF' and start = '1999-06'"""

# --- decisions -------------------------------------------------------------------------------------------------

CTES["declines"] = """select property_id, aspect, change_month, delta3, market3 from shifts_found
    where delta < 0"""
CTES["own_lines"] = """select aspect, string_agg(property_id || ' below the market from ' || change_month
    || ' (' || printf('%+.2f', delta3) || ')', '; ' order by property_id) as own_text,
    string_agg(property_id, ', ' order by property_id) as own_names, count(*) as own_n
    from declines group by 1"""
CTES["market_lines"] = f"""select aspect, string_agg({_TOLD}, '; ' order by coalesce(calendar_month, 13))
    as market_text from findings group by 1"""
CTES["market_names"] = """select aspect, string_agg(property_id, ', ' order by property_id) as names,
    count(*) as n from (select distinct aspect, property_id from participants) group by 1"""
CTES["scopes"] = f"""select aspect, coalesce(case when market_text is not null then n else own_n end, 0)
    as n_properties, {half_even('(case when market_text is not null then n else own_n end) / coverage', 3)}
    as fraction, case when market_text is not null then 'market-wide' else 'property-specific' end
    as scope_, coalesce(case when market_text is not null then names else own_names end, '') as properties,
    case when market_text is not null then market_text || coalesce('; also ' || own_text, '')
    else own_text end as pattern
    from own_lines full join market_lines using (aspect) left join market_names using (aspect)
    left join coverages using (aspect)"""
ORACLES["s1_market_scope"] = _sql("select * exclude (scope_), scope_ as scope from scopes")
ORACLES["s2_latest_declines"] = _sql("""select property_id, aspect, change_month, delta3 as delta
    from declines""")
CTES["since_rows"] = """select d.property_id, d.aspect, change_month,
    strptime(change_month || '-01', '%Y-%m-%d')::date as since from declines d"""
CTES["level_rows"] = """select property_id, aspect, change_month,
    (select avg(sentiment) from mentions m where m.property_id = r.property_id
      and m.aspect = r.aspect and date >= since) as now_,
    (select avg(mean) from (select avg(sentiment) as mean from mentions m where m.aspect = r.aspect
      and date >= r.since group by m.property_id)) as peers from since_rows r"""
ORACLES["s3_levels"] = _sql(f"""select property_id, aspect, change_month as started,
    {r6('now_')} as current, {r6('peers')} as reference, {r6('peers - now_')} as raw_gap
    from level_rows where peers > now_""")
CTES["tags"] = """select property_id, aspect, string_agg(coalesce(change_month, calendar_month::varchar), '|'
    order by coalesce(calendar_month, 13)) as variant from participants group by all"""
CTES["variant_units"] = """select v.variant, u.* from units u join (select distinct aspect, variant from tags) v
    using (aspect) where not exists (select 1 from participants p join tags t
      using (property_id, aspect) where t.variant = v.variant and p.aspect = u.aspect
      and (p.calendar_month = month(u.date)
           or u.date >= strptime(p.change_month || '-01', '%Y-%m-%d')::date))"""
CTES["variant_means"] = """select *, avg(mean) over (partition by aspect, variant) as cmean from (
    select variant, aspect, property_id, count(*) as reviews, sum(total) / sum(mentions) as mean
    from variant_units group by all)"""
ORACLES["s4_retested_lags"] = _sql(f"""select property_id, aspect, variant, reviews as new_reviews,
    {r6('mean')} as new_mean, {r6('cmean')} as new_cluster from variant_means
    join tags using (property_id, aspect, variant)""")
CTES["destination"] = f"""select aspect, {half_even('avg(mean)', 3)} as cluster_mean, sum(n) as n,
    {half_even('sum(neg) / sum(n)', 3)} as pct_negative, count(*) as n_properties_reviewed from (
    select aspect, property_id, avg(sentiment) as mean, count(*) as n, count_if(sentiment < 0) as neg
    from mentions group by all) group by 1"""
CTES["destination_scoped"] = """select d.* , coalesce(scope_, case when n_properties_reviewed < 3
    then 'undetermined' else 'stable' end) as scope_label, coalesce(pattern,
    'no significant negative shift') as pattern_text from destination d left join scopes using (aspect)"""
_DEST = """select aspect, cluster_mean, n::bigint as n, pct_negative, scope_label as scope,
    pattern_text as pattern, n_properties_reviewed from destination_scoped"""
ORACLES["s5_destination"] = _sql(_DEST)
ORACLES["s6_headline"] = _sql(_DEST + """ where scope_label = 'market-wide'
    order by pct_negative desc, aspect limit 1""")
ORACLES["s7_scope_counts"] = _sql("select scope_ as scope, count(*) as n_aspects from scopes group by 1")
ORACLES["s7_quadrant"] = _sql(f"""select {r6('avg(pct_negative)')} as mean_negative
    from scopes join destination using (aspect)""")
ORACLES["s8_shared_patterns"] = _sql("select distinct aspect, property_id from participants")

# --- search and sinks ---------------------------------------------------------------------------------------------

_FOUND = """select review_id, property_id, date, platform, rating, language_hint, m.aspect, m.sentiment,
    m.sentence from docs"""
ORACLES["x1_search"] = _sql(f"""{_FOUND} join (select review_id, aspect, sentiment, sentence
    from doc_mentions where aspect = 'Verb' and sentiment = 1) m using (review_id)
    where date between date '2024-03-01' and date '2025-06-30' and contains(lower(text), 'the ')""")
ORACLES["x1_search_all"] = _sql(f"""{_FOUND} left join (select review_id, aspect, sentiment, sentence
    from doc_mentions) m using (review_id) where property_id = 'src7'""")
ORACLES["x2_snapshot_json"] = _sql(f"""select property_id, aspect, date_trunc('month', date)::date as month,
    {r6('avg(sentiment)')} as mean, count(*) as n from mentions group by 1, 2, 3""")
ORACLES["x2_snapshot_scorecards"] = ORACLES["b5_benchmark_tests"]
ORACLES["x2_snapshot_scope"] = ORACLES["s1_market_scope"]
ORACLES["x2_snapshot_mentions"] = ORACLES["t9_label_reviews"]
ORACLES["x2_snapshot_meta"] = _sql("""select count(*) as n_reviews, strftime(min(date), '%Y-%m-%d') as date_min,
    strftime(max(date), '%Y-%m-%d') as date_max, 'documents' as source_name, count(*) as rows, true as files_bounded from docs""")
ORACLES["x3_csv"] = "select doc_id, md5(text) as text_md5 from documents"

# --- evaluation -------------------------------------------------------------------------------------------------------

_RANK = f"list_position({_list(list(TEST_ASPECTS))}, aspect)"
CTES["doc_units"] = """select review_id, aspect, sign(sum(sentiment))::int as s from doc_mentions group by all"""
CTES["doc_pred"] = f"""select d.review_id, coalesce(string_agg(aspect, ';' order by {_RANK}), '') as aspects,
    coalesce(string_agg(aspect || '=' || s, ';' order by {_RANK}), '') as pairs
    from docs d left join doc_units using (review_id) group by 1"""
ORACLES["e1_predictions"] = _sql("""select review_id, aspects as pred_aspects,
    pairs as pred_sentiment_per_aspect from doc_pred""")
_HEX = "list_transform(string_split(sha256(doc_id::varchar), ''), lambda h: strpos('0123456789abcdef', h) - 1)"
ORACLES["e2_hash_slices"] = f"""select doc_id as review_id, ['A', 'P', 'R'][1 + (list_reduce({_HEX},
    lambda a, b: (a * 16 + b) % 3, 0::bigint))::int] as annotator from documents"""
CTES["gold"] = """select doc_id as id, case when quality = 1 then case when toxic = 1 then 'Article;Verb'
    else 'Article;Preposition' end else '' end as aspects, case when quality = 1 then
    case when toxic = 1 then 'Article=-1;Verb=0' else 'Article=1;Preposition=1' end else '' end as pairs,
    quality = 1 or toxic = 1 as labelled, case when doc_id % 7 = 0 then 'sarcasm' end as sarcasm
    from labels"""
ORACLES["e3_parse_labels"] = _sql("""select id::varchar as review_id, aspects, pairs as sentiments,
    labelled from gold""")
CTES["gold_rows"] = """select id, unnest(string_split(aspects, ';')) as aspect from gold
    where labelled and aspects <> ''"""
CTES["gold_marks"] = """select id, split_part(x, '=', 1) as aspect, split_part(x, '=', 2)::int as g from (
    select id, unnest(string_split(pairs, ';')) as x from gold where labelled and pairs <> '')"""
CTES["pred_ids"] = "select review_id as id from docs where review_id % 10 <> 3"
CTES["pred_marks"] = """select review_id as id, aspect, s as p from doc_units"""
CTES["both_marks"] = """select coalesce(a.id, b.id) as id, coalesce(a.aspect, b.aspect) as aspect,
    a.id is not null as g, b.id is not null as p from gold_rows a full join (
    select * from pred_marks where id in (select id from gold where labelled)) b
    on a.id = b.id and a.aspect = b.aspect"""


def _prf(key: str, source: str) -> str:
    return f"""select *, {r6('case when tp + fp > 0 then tp / (tp + fp) else 0 end')} as precision,
    {r6('case when tp + fn > 0 then tp / (tp + fn) else 0 end')} as recall,
    {r6('case when tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end')} as f1 from ({source})"""


CTES["aspect_counts"] = """select aspect, count_if(g and p)::bigint as tp, count_if(p and not g)::bigint as fp,
    count_if(g and not p)::bigint as fn from both_marks group by 1"""
ORACLES["e4_aspect_scores"] = _sql(_prf("aspect", "select * from aspect_counts"))
ORACLES["e4_aspect_macro"] = _sql(f"""select {r6('avg(case when tp + fp > 0 then tp / (tp + fp) else 0 end)')}
    as precision, {r6('avg(case when tp + fn > 0 then tp / (tp + fn) else 0 end)')} as recall,
    {r6('avg(case when tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end)')} as f1
    from aspect_counts""")
CTES["matched"] = "select id, aspect, g, p from gold_marks join pred_marks using (id, aspect)"
ORACLES["e5_confusion"] = _sql("""select g as gold, count_if(p = -1) as pred_neg, count_if(p = 0) as pred_neu,
    count_if(p = 1) as pred_pos from matched group by 1""")
CTES["class_counts"] = """select label, count_if(g = label and p = label)::bigint as tp,
    count_if(p = label and g <> label)::bigint as fp, count_if(g = label and p <> label)::bigint as fn
    from matched, (select unnest([-1, 0, 1]) as label) group by 1 having tp + fp + fn > 0"""
ORACLES["e5_class_scores"] = _sql(_prf("label", "select * from class_counts"))
ORACLES["e5_sentiment_summary"] = _sql(f"""select (select count(*) from matched) as n_matched,
    (select {r6('avg(case when g = p then 1.0 else 0.0 end)')} from matched) as accuracy,
    {r6('avg(2 * tp / (2 * tp + fp + fn))')} as macro_f1 from class_counts""")
ORACLES["e6_error_analysis"] = _sql("""select category, count(*) as reviews, count_if(wrong) as errors from (
    select case when sarcasm is not null then 'sarcasm' when contains(gold.aspects, ';') then 'mixed_aspects'
      when len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) between 1 and 3
        or id % 11 = 0 then 'very_short' end as category,
      gold.aspects <> coalesce(p.aspects, '') as wrong
    from gold join documents on doc_id = id left join doc_pred p on p.review_id = id where labelled)
    where category is not null group by 1""")
ORACLES["e7_coverage"] = _sql("""select count_if(labelled)::bigint as n_reviews,
    count_if(labelled = false)::bigint as n_unlabelled_skipped,
    count_if(labelled and p.id is null) as n_missing_predictions,
    count_if(coalesce(labelled, false) = false and p.id is not null) as n_predictions_without_gold
    from gold full join pred_ids p on p.id = gold.id""")
ORACLES["e8_wilson"] = f"""select l_suppkey, k, n,
    {r6('greatest(0, (k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n))')} as ci_low,
    {r6('least(1, (k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n))')} as ci_high
    from (select l_suppkey, count_if(l_returnflag = 'R') as k, count(*) as n, 1.96::double as z
    from lineitem group by 1)"""

# --- learned sentiment --------------------------------------------------------------------------------------------------

CTES["turns"] = f"select conv_id || '-' || turn as id, {tokens(norm('text'))} as toks from conversations"
CTES["word_terms"] = """select id, 'w:' || w as term from (select id, unnest(toks) as w from turns)
    union all select id, 'w:' || toks[i] || ' ' || toks[i + 1] from (
      select id, toks, unnest(range(1, len(toks))) as i from turns)"""
CTES["char_terms"] = """select id, 'c:' || substr(w, i::int, n::int) as term from (
    select id, w, n, unnest(range(1, length(w) - n + 2)) as i from (
      select id, ' ' || w || ' ' as w, unnest([2, 3, 4, 5]) as n from (
        select id, unnest(toks) as w from turns)) where length(w) >= n)"""
CTES["terms"] = """select id, term, count(*) as cnt from (select * from word_terms union all
    select * from char_terms) group by all"""
CTES["vocab"] = f"""select term, ln((1.0 + (select count(*) from conversations)) / (1.0 + count(*))) + 1 as idf
    from terms group by 1 having count(*) >= 3 order by sum(cnt) desc, term limit {config.MODEL_MAX_FEATURES}"""
ORACLES["l1_features"] = _sql("""select term, count(*) as df, sum(cnt)::bigint as total from terms group by 1""")
ORACLES["l4_tfidf_terms"] = _sql(f"""select id, term, {r6('w / sqrt(sum(w * w) over (partition by id))')} as value
    from (select id, term, (1 + ln(cnt)) * idf as w from terms join vocab using (term))""")
ORACLES["l4_vocabulary"] = _sql(f"select term, {r6('idf')} as idf from vocab")
ORACLES["l2_corpus"] = _sql(f"""select review_id as id, case rank when 1 then 'train' when 2 then 'dev' else 'test' end
    as split, platform as source from (select *, row_number() over (partition by norm
      order by rank, review_id) as rn from (select *, case when review_id % 5 < 3 then 1 when review_id % 5 = 3
      then 2 else 3 end as rank from docs where norm <> ''
      and norm not in (select {norm('text')} from benchmark))) where rn = 1""")
def _split(*keys: str) -> str:
    tenth = f"('0x' || substr(sha256(concat_ws(':', '42', {', '.join(keys)})), 1, 12))::bigint % 10"
    return f"case when {tenth} < 8 then 'train' when {tenth} = 8 then 'dev' else 'test' end as split"


_T = "((avg(l_quantity) - 25.0) / (stddev_samp(l_quantity) / sqrt(count(*))))"
ORACLES["p1_t_p_values"] = f"""select l_suppkey, {r6('effect')} as effect, {r6('se')} as se,
    {r6('case when t >= 0 then tail else 1 - tail end')} as p_upper, {r6('least(1.0, 2 * tail)')} as p_two_sided
    from (select *, {t_tail('abs(t)', 'dof')} as tail from (
      select l_suppkey, avg(l_quantity) - 25.0 as effect, stddev_samp(l_quantity) / sqrt(count(*)) as se,
        {_T} as t, (count(*) - 1)::double as dof from lineitem group by 1))"""
_TRUE = "property_id = 'N7' and aspect = 'RF'"
_GAP = "abs(datediff('month', date '1999-06-01', (change_month || '-01')::date))"
ORACLES["e9_detection_rates"] = f"""select measure, k, n, {r6('k / n')} as rate,
    {r6('greatest(0, (k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n))')} as ci_low,
    {r6('least(1, (k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n))')} as ci_high
    from (select unnest(['found', 'exact_month', 'any_extra']) as measure,
        unnest([count_if(found), count_if(exact), count_if(extra)]) as k,
        (select count(distinct n_regionkey) from supplier join nation on s_nationkey = n_nationkey) as n, 1.96::double as z
      from (select cluster_id, coalesce(bool_or({_TRUE} and direction = 'negative' and {_GAP} <= 1), false) as found,
        coalesce(bool_or({_TRUE} and direction = 'negative' and {_GAP} = 0), false) as exact,
        coalesce(bool_or(not ({_TRUE})), false) as extra
        from ({ORACLES['c6_changepoints_by_region']}) group by cluster_id))"""
CTES["train_rows"] = """select doc_id, lang as source, case when toxic = 1 then -1 when quality = 1 then 1 else 0 end
    as label from labels join documents using (doc_id)"""
ORACLES["l3_grouped_splits"] = _sql(f"""select doc_id as id, d.source as "group", {_split('d.source')}
    from train_rows t join documents d using (doc_id)""")
ORACLES["l3_stratified_splits"] = _sql(f"""select doc_id as id, label, {_split('label', 'doc_id')} from train_rows""")
ORACLES["l6_majority_baseline"] = _sql(f"""select source, n, {r6('2 * top / (n + top) / 3')} as macro_f1 from (
    select source, sum(k)::bigint as n, max(k) as top from (select source, label, count(*) as k
    from train_rows group by all) group by 1)""")
CTES["given_scores"] = """select c.id, c.label, coalesce(s, 0) + (case c.label when -1 then 0.1::double when 0 then 0.05::double else 0::double end) as score
    from (select conv_id || '-' || turn as id, unnest([-1, 0, 1]) as label from conversations) c
    left join (select id, label, sum(w * (((ascii(right(term, 1)) * (label + 3) + length(term) * 5) % 13 - 6) / 6.0::double)) / any_value(norm) as s
      from (select *, unnest([-1, 0, 1]) as label from (select id, term, w, sqrt(sum(w * w) over (partition by id)) as norm
        from (select id, term, (1 + ln(cnt)) * idf as w from terms join vocab using (term)))) group by 1, 2) t
    on t.id = c.id and t.label = c.label"""
ORACLES["l5_score_texts"] = _sql(f"""select id, label as pred, {r6('score - next')} as margin from (
    select *, row_number() over (partition by id order by score desc, label) as rk,
      lead(score) over (partition by id order by score desc, label) as next from given_scores) where rk = 1""")
CTES["report_rows"] = f"""select *, {clause_score('norm', tokens('norm'))} as rules, 'town' || (id % 7 % 3) as town, (id % 3 - 1)::int as sign
    from (select l.doc_id as id, d.lang as source, d.source as grp, case when toxic = 1 then -1 when quality = 1 then 1 else 0 end as gold,
      {norm('text')} as norm from labels l join documents d using (doc_id))"""
CTES["report_towns"] = """select source, town from report_rows group by all
    having count(*) >= greatest(1, (select count(*) from report_rows) // 9)"""
CTES["report_tests"] = """select r.id, r.source, grp, gold, t.town, unnest(['rules', 'sign']) as system, unnest([rules, sign]) as pred
    from report_rows r left join report_towns t on r.source is not distinct from t.source and r.town = t.town where substr(md5(r.id::varchar), 1, 1) < '4'"""
CTES["report_cells"] = """
    select system, '*' as source, '*' as grp, '*' as town, gold, pred, count(*) as n from report_tests group by all
    union all select system, source, '*', '*', gold, pred, count(*) from report_tests where source is not null group by all
    union all select system, source, grp, '*', gold, pred, count(*) from report_tests where source is not null and grp is not null group by all
    union all select system, source, '*', town, gold, pred, count(*) from report_tests where source is not null and town is not null group by all"""
_CLASSES = """select system, source, grp, town, label, coalesce(sum(n) filter (gold = label and pred = label), 0)::double as tp,
    coalesce(sum(n) filter (gold <> label and pred = label), 0)::double as fp, coalesce(sum(n) filter (gold = label and pred <> label), 0)::double as fn
    from (select *, unnest([-1, 0, 1]) as label from report_cells) group by 1, 2, 3, 4, 5"""
_F1 = "case when tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end"
ORACLES["l6_class_report"] = _sql(f"""select system, source, grp as "group", town, label,
    {r6('case when tp + fp > 0 then tp / (tp + fp) else 0 end')} as precision,
    {r6('case when tp + fn > 0 then tp / (tp + fn) else 0 end')} as recall, {r6(_F1)} as f1, (tp + fn)::bigint as support from ({_CLASSES})""")
ORACLES["l6_confusion"] = _sql("""select system, source, grp as "group", town, gold, coalesce(sum(n) filter (pred = -1), 0)::bigint as as_0,
    coalesce(sum(n) filter (pred = 0), 0)::bigint as as_1, coalesce(sum(n) filter (pred = 1), 0)::bigint as as_2 from report_cells group by 1, 2, 3, 4, 5""")
ORACLES["l6_test_report"] = _sql(f"""select c.*, {r6('f.macro')} as macro_f1 from (select system, source, grp as "group", town, sum(n)::bigint as n,
    {r6('coalesce(sum(n) filter (gold = pred), 0) / sum(n)')} as accuracy from report_cells group by 1, 2, 3, 4) c
    join (select system, source, grp, town, avg({_F1}) as macro from ({_CLASSES}) group by 1, 2, 3, 4) f
    on c.system = f.system and c.source = f.source and c."group" = f.grp and c.town = f.town""")
