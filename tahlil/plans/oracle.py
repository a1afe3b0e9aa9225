"""SQL of the core queries, for an engine that has no part in them."""

from __future__ import annotations

from tahlil.functions.patterns import CAPITALS, LETTERS
from tahlil.operators import classify, gate, names, report, rules, spans
from tahlil.plans.queries import LAYERS
from tahlil.sources import files


def q(x: str) -> str:
    """A SQL string."""
    return "'" + x.replace("'", "''") + "'"


def listed(xs) -> str:
    """A SQL list of strings."""
    return "[" + ", ".join(map(q, xs)) + "]"


def fold(x: str) -> str:
    """Lower case in Turkish."""
    return f"lower(translate({x}, 'İI', 'iı'))"


def dotless(x: str) -> str:
    """Lower case with one i."""
    return f"translate({fold(x)}, 'ı', 'i')"


def plain7(x: str) -> str:
    """Folded to seven bits."""
    return f"regexp_replace(translate({fold(x)}, 'çğıöşüÇĞİÖŞÜ', 'cgiosuCGIOSU'), '[^\\x20-\\x7E\\n]', '?', 'g')"


def joined(x: str) -> str:
    """A list as text."""
    return f"array_to_string({x}, '|')"


def words_of(x: str) -> str:
    """The words of a text."""
    return f"list_filter(regexp_split_to_array({x}, '[^{LETTERS}0-9_]+'), lambda w: w <> '')"


# Mask tags of the specification (fixed values).
MASK_TAG = "\\[[A-Z_]+_SILINDI\\]|\\[YAS_ARALIGI:[^\\]]*\\]|\\[COKLU_ALAN_SILINDI\\]|\\[KAPI_BULGUSU_[0-9]+:[a-z]+\\]"
BARE_TAG = "[A-Z_]*_SILINDI|YAS_ARALIGI|KAPI_BULGUSU_[0-9]+"


def stripped(x: str) -> str:
    """A finding without tags and punctuation."""
    return f"regexp_replace(regexp_replace(regexp_replace({x}, {q(MASK_TAG)}, ' ', 'g'), {q(BARE_TAG)}, ' ', 'g'), '^[ \\t\\n.:;,\\-\\[\\]]+|[ \\t\\n.:;,\\-\\[\\]]+$', '', 'g')"


def is_real(f: str, t: str) -> str:
    """Whether a finding stands in a text."""
    a, b = fold(stripped(f)), fold(t)
    w = f"list_filter({words_of(a)}, lambda w: length(w) >= 3 AND NOT list_contains(['dr', 'prof', 'uzm', 'doç'], w))"
    return f"coalesce(length({a}) >= 2 AND (contains({b}, {a}) OR (len({w}) > 0 AND len(list_filter({w}, lambda w: NOT contains({b}, w))) = 0)), false)"


# The final rules of the specification, in RE2's words (fixed values).
FINAL_RULES = (
    ("tc", "\\b[1-9][0-9]{10}\\b"),
    ("date", "\\b[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}\\b"),
    ("date_short", "\\b[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2}\\b"),
    ("date_iso", "\\b(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}\\b"),
    ("email", "[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\\.[0-9A-Za-z_.]+"),
    ("phone", "(?:^|[^0-9])0?[ \\t-]?\\(?5[0-9]{2}\\)?[ \\t-]?[0-9]{3}[ \\t-]?[0-9]{2}[ \\t-]?[0-9]{2}(?:$|[^0-9])"),
    ("landline", "(?:^|[^0-9])(?:\\+90|0)[ \\t(]?[2-4][0-9]{2}[ \\t)]?[ \\t-]?[0-9]{3}[ \\t-]?[0-9]{2}[ \\t-]?[0-9]{2}(?:$|[^0-9])"),
    ("url", "https?://[^ \\t\\n]+|www\\.[^ \\t\\n]+"),
)


def final_rule(x: str) -> str:
    """The first final rule a text breaks."""
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {q(p)}) THEN {q(n)}" for n, p in FINAL_RULES) + " END"


def parts(c: str) -> str:
    """Folded candidates and their words."""
    whole = f"list_filter(list_transform({c}, lambda c: regexp_replace({fold('trim(c)')}, '[ \\t\\n]+', ' ', 'g')), lambda c: length(c) >= 3)"
    some = f"list_filter(flatten(list_transform({whole}, lambda c: string_split(c, ' '))), lambda w: length(w) >= 4 AND NOT list_contains({listed(gate.STOP_TOKENS)}, w) AND NOT regexp_matches(w, '^[0-9]+$'))"
    return f"list_distinct(list_concat({whole}, {some}))"


def remaining(c: str, t: str) -> str:
    """Candidates that stand in a text."""
    padded = f"(' ' || regexp_replace({fold(t)}, '[^{LETTERS}0-9_]+', ' ', 'g') || ' ')"
    return f"list_sort(list_filter({parts(c)}, lambda p: contains({padded}, ' ' || trim(regexp_replace(p, '[^{LETTERS}0-9_]+', ' ', 'g')) || ' ')))"


def tokens(x: str) -> str:
    """Capital words and numbers."""
    return f"list_distinct(regexp_extract_all({x}, '([{CAPITALS}]{{3,}}|[0-9]{{5,}})', 1))"


def evidence(t: str) -> str:
    """Categories with their keywords in a text."""
    padded = f"(' ' || regexp_replace({fold(t)}, '[^{LETTERS}0-9]+', ' ', 'g') || ' ')"
    rows = ", ".join(f"{{'ord': {i}, 'category': {q(c)}, 'keywords': list_filter({listed(k for k in ks if k not in classify.GENERIC)}, lambda k: contains({padded}, ' ' || k || ' '))}}" for i, (c, ks) in enumerate(classify.KEYWORDS.items()))
    return f"list_filter([{rows}], lambda r: len(r.keywords) > 0)"


def category(raw: str) -> str:
    """The category of a free entry; `raw` is a column."""
    low = f"translate(lower(trim({raw})), ' -', '__')"
    every = listed(classify.CATEGORIES)
    organs = "[" + ", ".join(f"{{'k': {q(k)}, 'v': {q(v)}}}" for k, v in sorted(classify.ORGANS.items(), key=lambda o: (-len(o[0]), o[0]))) + "]"
    return (
        f"coalesce(CASE WHEN list_contains({every}, trim({raw})) THEN trim({raw}) END, list_filter({every}, lambda c: lower(c) = {low})[1],"
        f" CASE WHEN {low} <> '' THEN list_filter({every}, lambda c: contains('_' || {low} || '_', '_' || lower(c) || '_'))[1] END,"
        f" list_filter({organs}, lambda o: contains({fold(raw)}, o.k))[1].v, 'Other')"
    )


def contradictions(t: str, cat: str, site: str) -> str:
    """Warnings about a text against its category."""
    has = lambda x, ws: "(" + " OR ".join(f"contains({x}, {q(w)})" for w in ws) + ")"
    x = fold(t)
    meta = f"{has(x, ('metastaz', 'metastatik', 'sekonder', 'yayılım'))} AND contains({fold(site)}, 'metastaz')"
    negated = f"regexp_replace({x}, {q(classify.NEGATED)}, '', 'g')"
    benign = f"{has(x, classify.BENIGN)} AND NOT {has(negated, classify.MALIGN)} AND {cat} <> 'Other'"
    return f"list_filter([CASE WHEN {meta} THEN 'Primer tümör yeri metastaz bölgesi olabilir' END, CASE WHEN {benign} THEN 'Benign bulgular, kanser kategorisi' END], lambda w: w IS NOT NULL)"


BODY = "concat_ws('. ', gerekce, histolojik_tip, primer_bolge, ozet)"
CANDIDATES = "list_transform(spans, lambda s: s.text)"
# Mask tags of the forms as spans, each with a wider one around it.
TAGGED = """(SELECT ner_id, text, 1 + CAST(coalesce(list_sum(list_transform(ps[1:k], lambda p: length(p) + 1)), 0) AS INTEGER) - 2 AS s, ps[k + 1] AS p
    FROM (SELECT ner_id, text, ps, unnest(range(1, len(ps))) AS k FROM (SELECT ner_id, text, string_split(text, '[') AS ps FROM ner_result WHERE text IS NOT NULL)) WHERE contains(ps[k + 1], '_SILINDI]'))"""
RAW = f"""(SELECT ner_id, any_value(text) AS raw, list({{'start': a, 'end': b, 'label': l, 'score': sc}} ORDER BY s, sc DESC) AS spans FROM (
    SELECT ner_id, text, s, s AS a, CAST(least(length(text), s + instr(p, ']') + 1) AS INTEGER) AS b, 'person' AS l, CAST(0.9 AS DOUBLE) AS sc FROM {TAGGED}
    UNION ALL SELECT ner_id, text, s, greatest(0, s - 3), CAST(least(length(text), s + instr(p, ']') + 3) AS INTEGER), 'address', CAST(0.5 AS DOUBLE) FROM {TAGGED}) GROUP BY ner_id)"""
BARE_TEXT = "regexp_replace(text, '^[ \\t\\n\\f]+|[ \\t\\n\\f]+$', '', 'g')"
LINES = "(SELECT ocr_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT ocr_id, string_split(text, chr(10)) AS l FROM ocr_result WHERE text IS NOT NULL))"
SECTION = f"""
    SELECT ocr_id, line_no, line, coalesce(last_value(flag IGNORE NULLS) OVER (PARTITION BY ocr_id ORDER BY line_no), false) AS medical
    FROM (SELECT *, CASE WHEN regexp_matches(line, {q(names.STOPS)}) THEN false WHEN regexp_matches(line, {q(names.STARTS)}) THEN true END AS flag FROM {LINES})"""
WORDS = f"(SELECT ocr_id, line_no, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM (SELECT ocr_id, line_no, regexp_extract_all(line, '([{LETTERS}]+)', 1) AS w FROM @lines))"
UP = lambda x: f"upper(translate({x}, 'iı', 'İI'))"
DICT = f"""(SELECT word, bool_or(is_first) AS is_first, bool_or(is_surname) AS is_surname FROM (
    SELECT {UP('token')} AS word, is_first, is_surname FROM name_lexicon WHERE token IS NOT NULL
    UNION ALL SELECT translate({UP('token')}, 'çğıöşüÇĞİÖŞÜ', 'cgiosuCGIOSU'), is_first, is_surname FROM name_lexicon WHERE token IS NOT NULL) GROUP BY word)"""
NAME_PAIRS = f"""
    WITH sec AS ({SECTION}), lines AS (SELECT * FROM sec WHERE NOT medical),
    p AS (SELECT ocr_id, line_no, pos, word AS w1, lead(word) OVER (PARTITION BY ocr_id, line_no ORDER BY pos) AS w2 FROM {WORDS.replace('@lines', 'lines')}),
    d AS {DICT},
    j AS (SELECT p.*, coalesce(a.is_first, false) f1, coalesce(a.is_surname, false) s1, coalesce(b.is_first, false) f2, coalesce(b.is_surname, false) s2, {UP('w1')} u1, {UP('w2')} u2
      FROM p LEFT JOIN d a ON a.word = {UP('w1')} LEFT JOIN d b ON b.word = {UP('w2')}
      WHERE w2 IS NOT NULL AND length(w1) <= 20 AND length(w2) BETWEEN 2 AND 20 AND NOT (regexp_matches(w1, '^[{CAPITALS}]') AND NOT regexp_matches(w2, '^[{CAPITALS}]')))
    SELECT ocr_id, CAST(line_no AS INTEGER) AS line_no, CAST(pos AS INTEGER) AS pos, w1, w2 FROM j
    WHERE ((f1 OR s1) AND (f2 OR s2)) OR ((f1 OR s1) AND list_contains({listed(names.POLITE)}, u2)) OR (length(w1) = 1 AND regexp_matches(w1, '^[{CAPITALS}]$') AND s2) OR (f1 AND ({' OR '.join(f"suffix(u2, {q(s)})" for s in names.SUFFIXES)}) AND NOT list_contains({listed(names.AMBIGUOUS)}, u1) AND NOT list_contains({listed(names.AMBIGUOUS)}, u2))"""


# The words that the specification of the gate lists, kept apart from the operators' own (fixed values).
GATE_STOP = """hasta velisi veli doktor hekim imza kaşe kase adı adi soyadı soyadi isim ismi tarih tarihi onay onaylayan raporlayan patolog uzman
    uzmanı asistan servis isteyen gönderen gonderen klinik bölüm bolum no tc kimlik numarası numara randevu numune kabul saat saati protokol
    rapor revizyon revize diploma dipl tescil ve bilgileri bilgi doğum dogum yeri cinsiyet yaş yas barkod istem alım alim alındığı alindigi
    alınış alinis doku kurum adres adresi web tel telefon faks posta e-posta email sorumlu gönd gond dokt kaydeden hazırlayan hazirlayan
    form formu sayfa baba anne eş es yakını yakini dr prof uzm""".split()
GATE_CAPITALS = """adi soyadi hasta doktor tarih tarihi saat tel faks adres kurum web posta mail kimlik tc no sağlik saglik bakanliği bakanligi
    hastanesi şehir sehir devlet üniversitesi tip fakültesi laboratuvari laboratuvar patoloji tibbi raporu sonuç tetkik formu talep numune
    bilgileri prof uzm doç asistan dipl tescil onay kabul istem rapor revize protokol dosya tetkikler biyopsi materyal alindiği aliniş alinis""".split()
GATE_RULES = (  # kind, pattern, which group is the finding
    ("id", "\\b[1-9][0-9]{10}\\b", 0),
    ("date", "\\b[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}\\b", 0),
    ("contact", "[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\\.[0-9A-Za-z_.]+", 0),
    ("contact", "(?:^|[^0-9])(0?[ \\t]?\\(?5[0-9]{2}\\)?[ \\t-]?[0-9]{3}[ \\t-]?[0-9]{2}[ \\t-]?[0-9]{2})(?:$|[^0-9])", 1),
    ("contact", "(?:https?://|www\\.)[^ \\t\\n]+", 0),
    ("person", "\\[(?:DOKTOR|HEKIM|HASTA_ADI|HASTA|ISIM|KISI|BABA_ADI|PII)_SILINDI\\][ \\t]+((?:\\p{Lu}\\p{L}{2,}[ \\t]*){1,3})", 1),
)


def residual_union() -> str:
    """Rows (ner_id, type) of the residual findings, names of the dictionary included."""
    out, stop = [], listed(sorted({w.replace("ı", "i") for w in GATE_STOP} | set(GATE_CAPITALS)))
    for kind, p, group in GATE_RULES:
        more = f" AND NOT list_contains({stop}, {dotless('regexp_split_to_array(h, ' + q('[ \t]+') + ')[1]')})" if kind == "person" else ""
        out.append(f"SELECT ner_id, {q(kind)} AS type FROM (SELECT ner_id, text, trim(unnest(regexp_extract_all(text, {q(p)}, {group}))) AS h FROM ner_result) WHERE {is_real('h', 'text')}{more}")
    lines = "SELECT ner_id, text, unnest(string_split(text, chr(10))) AS line FROM ner_result WHERE text IS NOT NULL"
    # runs of capitals stand between borders that are no letter, digit or underscore; each word with the next
    runs = f"SELECT ner_id, text, string_split(regexp_replace(unnest(regexp_extract_all(line, '(?:^|[^\\p{{L}}0-9_])(\\p{{Lu}}{{2,20}}(?:[ \\t]+\\p{{Lu}}{{2,20}})+)', 1)), '[ \\t]+', ' ', 'g'), ' ') AS w FROM ({lines})"
    two = f"SELECT DISTINCT ner_id, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT ner_id, w, unnest(range(1, len(w))) AS i FROM ({runs}))"
    label = "^[^:\\n]{1,30}:[ \\t]*(\\p{Lu}\\p{L}{1,19})[ \\t]+(\\p{Lu}\\p{L}{1,19})[ \\t]*$"
    value = f"SELECT DISTINCT ner_id, regexp_extract(line, {q(label)}, 1) AS w1, regexp_extract(line, {q(label)}, 2) AS w2 FROM ({lines}) WHERE regexp_matches(line, {q(label)})"
    out.append(f"SELECT ner_id, 'person' AS type FROM ({two}) WHERE {UP('w1')} IN (SELECT word FROM {DICT} WHERE is_first) AND {UP('w2')} IN (SELECT word FROM {DICT} WHERE is_surname)")
    out.append(f"SELECT ner_id, 'person' AS type FROM ({value}) WHERE {UP('w1')} IN (SELECT word FROM {DICT} WHERE is_first) AND NOT list_contains({stop}, {dotless('w2')})")
    return " UNION ALL ".join(out)


def markdown() -> str:
    """Reports as text."""
    facts = (("Histolojik tip", "histolojik_tip"), ("Primer bölge", "primer_bolge"), ("Evre (TNM)", "evre_tnm"), ("Derece", "derece"), ("Cerrahi sınır", "cerrahi_sinir"), ("Lenf nodu", "lenf_nodu"), ("Yaş aralığı", "yas_araligi"), ("Cinsiyet", "cinsiyet"))
    nl = "chr(10)"
    para = f"{nl} || {nl}"
    head = "'**Otomatik özet** — kategori **' || coalesce(kategori, 'Other') || '** · malignite: ' || coalesce(malignite_durumu, '-') || ' · okunabilirlik: ' || coalesce(okunabilirlik, '-')"
    fact = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} <> '' THEN '- **{n}:** ' || {c} END" for n, c in facts) + f"], lambda x: x IS NOT NULL), {nl})"
    bullets = lambda t, x: f"CASE WHEN len({x}) > 0 THEN '**{t}**' || {para} || array_to_string(list_transform({x}, lambda y: '- ' || coalesce(y, '')), {nl}) END"
    marks = f"CASE WHEN len(belirtecler) > 0 THEN '**Belirteçler**' || {para} || '| Belirteç | Sonuç |' || {nl} || '|---|---|' || {nl} || array_to_string(list_transform(belirtecler, lambda m: '| ' || coalesce(m.ad, '') || ' | ' || coalesce(m.deger, '') || ' |'), {nl}) END"
    end = f"'**Özet:** ' || coalesce(ozet, '') || {para} || '*Gerekçe:* ' || coalesce(gerekce, '')"
    blocks = [head, f"nullif({fact}, '')", marks, bullets("Önemli bulgular", "list_transform(onemli_bulgular, lambda b: b.madde)"), bullets("Tedavi / plan", "tedavi_ve_plan"), bullets("Önerilen ek tetkik", "onerilen_ek_tetkik"), end, bullets("Belirsizlikler", "belirsizlikler")]
    return f"concat_ws({para}, {', '.join(blocks)})"


def forms() -> str:
    """Made-up forms."""
    pick = lambda xs, n: f"{listed(xs)}[({n}) + 1]"
    lines = (
        f"'Hasta Adi Soyadi: ' || {pick(files.FIRST, 'c_custkey % 5')} || ' ' || {pick(files.LAST, 'o_orderkey % 4')}",
        "'TC Kimlik No: ' || (10000000000 + o_orderkey * 7919 + c_custkey)",
        "'Protokol No: ' || (10000 + o_orderkey % 80000) || '/' || (20 + o_orderkey % 7)",
        "'Tarih: ' || strftime(o_orderdate, '%d.%m.%Y') || '    Yas: ' || (20 + c_custkey % 70)",
        "'Tel: 05' || (30 + o_orderkey % 30) || ' ' || (100 + c_custkey % 900) || ' 12 34'",
        f"'Gonderen Doktor: Uzm. Dr. ' || {pick(files.FIRST, 'o_orderkey % 5')} || ' ' || {pick(files.LAST, 'c_custkey % 4')}",
        "'TANI:'",
        "'bulgu ' || lower(n_name)",
    )
    return f"SELECT o_orderkey AS form_id, concat_ws(chr(10), {', '.join(lines)}) AS text FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def validated() -> str:
    """What is left of the confidence."""
    cut = f"regexp_replace(body, '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g')"  # noqa: F541
    return f"""
    WITH a AS (SELECT report_id, kategori, coalesce(guven, 0.0) AS conf, primer_bolge AS site, {BODY} AS body FROM doctor_report),
    b AS (SELECT *, {evidence('body')} AS ev FROM a),
    c AS (SELECT *, list_sort(list_transform(ev, lambda r: {{'s': -len(r.keywords), 'o': r.ord, 'c': r.category, 'k': r.keywords}}))[1] AS top, list_filter(ev, lambda r: r.category = kategori)[1].keywords AS own FROM b),
    d AS (SELECT *, coalesce(own, top.k, CAST([] AS VARCHAR[])) AS matches FROM c),
    e AS (SELECT *, coalesce(top.c <> kategori AND -top.s > len(matches), false) AS conflict FROM d),
    f AS (SELECT *, conf * CASE WHEN conflict THEN {classify.PENALTY_CONFLICT} ELSE 1.0 END AS mid, length({cut}) < {classify.SHORT} AS short, {contradictions('body', 'kategori', 'site')} AS contra FROM e)
    SELECT report_id, top.c AS best_category, {joined('matches')} AS matches,
      CAST(CAST(conflict AS INT) + CAST(mid < 0.6 AS INT) + CAST(mid < 0.4 AS INT) + len(contra) + CAST(short AS INT) AS INTEGER) AS n_warnings,
      (CAST(conflict AS INT) + CAST(mid < 0.6 AS INT) + len(contra) + CAST(short AS INT)) = 0 AS is_valid,
      CAST(round_even(mid * CASE WHEN short THEN {classify.PENALTY_SHORT} ELSE 1.0 END, 3) AS DOUBLE) AS confidence_adjusted FROM f"""


def overlay() -> str:
    """Spans, merged and replaced by tags."""
    tag = "CASE label " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in spans.TAGS.items()) + f" ELSE {q(spans.OTHER_TAG)} END"
    return f"""
    WITH RECURSIVE m AS ({merged_rows()}),
    n AS (SELECT *, row_number() OVER (PARTITION BY ner_id ORDER BY s DESC) AS k, count(*) OVER (PARTITION BY ner_id) AS last FROM m),
    r AS (SELECT ner_id, CAST(0 AS BIGINT) AS k, text AS t FROM ner_result WHERE ner_id IN (SELECT ner_id FROM m)
      UNION ALL SELECT r.ner_id, r.k + 1, substr(r.t, 1, n.s) || {tag} || substr(r.t, n.e + 1) FROM r JOIN n ON n.ner_id = r.ner_id AND n.k = r.k + 1)
    SELECT r.ner_id, r.t AS masked FROM r JOIN (SELECT ner_id, max(k) AS k FROM n GROUP BY ner_id) x ON x.ner_id = r.ner_id AND x.k = r.k"""


def merged_rows() -> str:
    """(ner_id, s, e, label): merged spans; the label is that of the longest part, then of the highest score, then the
    first."""
    return f"""
    SELECT ner_id, min(s) AS s, max(e) AS e, arg_max(label, (e - s) * 1000000 + score * 1000 - i * 0.0001) AS label FROM (
      SELECT *, sum(CASE WHEN s < before THEN 0 ELSE 1 END) OVER (PARTITION BY ner_id ORDER BY i) AS island FROM (
        SELECT *, max(e) OVER (PARTITION BY ner_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
          SELECT ner_id, row_number() OVER (PARTITION BY ner_id ORDER BY x.start, x."end" DESC, x.score DESC) AS i, x.start AS s, x."end" AS e, x.label AS label, x.score AS score FROM (
            SELECT ner_id, unnest(spans) AS x FROM {RAW})))) GROUP BY ner_id, island"""


# Of the specification of names (fixed values): endings of surnames, words that are ordinary ones too, words behind a name.
MEDICAL_VOCABULARY = "adenokarsinom karsinom lenfoma melanom sarkom adenom tümör meningiom seminom meme mide deri over akciğer karaciğer böbrek prostat mesane tiroid beyin pankreas testis plevra larinks rektum hücreli bazal berrak küçük büyük patoloji onkoloji biyopsi tanı sonuç".split()
MARKER_FORM = "^(?:ck|cd|bcl|sox|gata|cdx|her|ki|ttf|pt?[0-3]|pn|pm|grade|derece|evre)[ -]?[0-9a-z]*$"
NAME_ENDINGS = "OĞLU OGLU GİL GIL KAYA DERE TAŞ ÖZ ALAN KIRAN BAŞ".split()
ORDINARY = "DENİZ DENIZ UMUT GÜNEŞ GUNES TOPRAK BAHAR YONCA ÇINAR CINAR KARANFİL BARIŞ BARIS YILDIZ KAYA TAŞ SELİM ORAL CAN GÜL ATEŞ".split()


def masked_names() -> str:
    """Texts without the names of the dictionary, by place, and without capitals left behind a tag.

    Each line outside the medical sections is cut into runs of letters and what stands between them. A name begins at a run if it and
    the next one, with only blanks between (or a full stop behind an initial), are a pair of the specification; a known third
    run belongs to it. Runs that belong to a name, and the blanks between such runs, become one tag.
    """
    tag = "'[ISIM_SILINDI]'"
    return f"""
    WITH lines AS ({SECTION}),
    cut AS (SELECT ocr_id, line_no, generate_subscripts(ps, 1) AS k, unnest(ps) AS p, medical FROM (SELECT ocr_id, line_no, medical, regexp_extract_all(line, '[{LETTERS}]+|[^{LETTERS}]+') AS ps FROM lines)),
    d AS {DICT},
    f AS (SELECT cut.*, regexp_matches(p, '^[{LETTERS}]') AS is_word, {UP('p')} AS u, coalesce(a.is_first, false) OR coalesce(b.is_first, false) AS f, coalesce(a.is_surname, false) OR coalesce(b.is_surname, false) AS s
      FROM cut LEFT JOIN d a ON a.word = {UP('p')} AND length(p) BETWEEN 2 AND 20 LEFT JOIN d b ON b.word = translate({UP('p')}, 'ÇĞİÖŞÜ', 'CGIOSU') AND length(p) BETWEEN 2 AND 20),
    n AS (SELECT *, lead(p) OVER w AS gap, lead(p, 2) OVER w AS p2, lead(u, 2) OVER w AS u2, lead(f, 2) OVER w AS f2, lead(s, 2) OVER w AS s2, lead(p, 3) OVER w AS gap2, coalesce(lead(f, 4) OVER w OR lead(s, 4) OVER w, false) AS known3 FROM f WINDOW w AS (PARTITION BY ocr_id, line_no ORDER BY k)),
    g AS (SELECT *, length(p) = 1 AND regexp_matches(p, '^[{CAPITALS}]$') AS initial, regexp_full_match(gap, '[ \\t]+') AS blank FROM n),
    h AS (SELECT *, coalesce(is_word AND NOT medical AND p2 IS NOT NULL AND (blank OR (initial AND regexp_full_match(gap, '\\.[ \\t]*'))) AND length(p) <= 20 AND length(p2) BETWEEN 2 AND 20
        AND NOT (regexp_matches(p, '^[{CAPITALS}]') AND NOT regexp_matches(p2, '^[{CAPITALS}]'))
        AND (((f OR s) AND (f2 OR s2)) OR ((f OR s) AND u2 IN ('BEY', 'HANIM')) OR (initial AND s2) OR (f AND ({' OR '.join(f"suffix(u2, {q(x)})" for x in NAME_ENDINGS)}) AND NOT list_contains({listed(ORDINARY)}, u) AND NOT list_contains({listed(ORDINARY)}, u2))), false) AS pair FROM g),
    t AS (SELECT *, pair AND known3 AND coalesce(regexp_full_match(gap2, '[ \\t]+'), false) AS triple FROM h),
    c AS (SELECT *, CASE WHEN is_word THEN pair OR coalesce(lag(pair, 2) OVER w, false) OR coalesce(lag(triple, 4) OVER w, false) ELSE coalesce(lag(pair) OVER w, false) OR coalesce(lag(triple, 3) OVER w, false) END AS covered FROM t WINDOW w AS (PARTITION BY ocr_id, line_no ORDER BY k)),
    e AS (SELECT *, covered OR coalesce(NOT is_word AND regexp_full_match(p, '[ \\t]+') AND lag(covered) OVER w AND lead(covered) OVER w, false) AS gone FROM c WINDOW w AS (PARTITION BY ocr_id, line_no ORDER BY k)),
    o AS (SELECT *, CASE WHEN NOT gone THEN p WHEN coalesce(lag(gone) OVER (PARTITION BY ocr_id, line_no ORDER BY k), false) THEN '' ELSE {tag} END AS piece FROM e),
    l AS (SELECT ocr_id, line_no, string_agg(piece, '' ORDER BY k) AS line FROM o GROUP BY ocr_id, line_no),
    x AS (SELECT lines.ocr_id, string_agg(coalesce(l.line, ''), chr(10) ORDER BY lines.line_no) AS text FROM lines LEFT JOIN l ON l.ocr_id = lines.ocr_id AND l.line_no = lines.line_no GROUP BY lines.ocr_id)
    SELECT r.ocr_id, regexp_replace(regexp_replace(x.text, '(\\[(?:DOKTOR|HASTA_ADI|ISIM|BABA_ADI)_SILINDI\\])(?:[ \\t]+[{CAPITALS}]{{2,}}(?:[ \\t]*\\.)?)+([ \\t]*(?:\\n|$|[:|]))', '\\1\\2', 'g'), '\\[ISIM_SILINDI\\](?:[ \\t]*\\[ISIM_SILINDI\\])+', {tag}, 'g') AS masked
    FROM ocr_result r LEFT JOIN x ON x.ocr_id = r.ocr_id"""


def redacted() -> str:
    """Reports with bad texts replaced, and where."""
    bad = lambda leaf: f"coalesce(len({remaining('cands', leaf)}) > 0 OR {final_rule(leaf)} IS NOT NULL, false)"
    new = lambda c: f"CASE WHEN {bad(c)} THEN {q(report.LEFT)} ELSE {c} END AS {c}"
    paths = [f"CASE WHEN {bad(c)} THEN [{q(c)}] ELSE [] END" for c in report.TEXTS]
    items = [(c, None) for c in report.LISTS] + [(c, f) for c, fields in report.STRUCTS.items() for f in fields]
    for c, f in items:
        leaf = f"v.{f}" if f else "v"
        end = f"].{f}" if f else "]"
        paths.append(f"coalesce(list_filter(list_transform({c}, lambda v, i: CASE WHEN {bad(leaf)} THEN '{c}[' || (i - 1) || '{end}' END), lambda x: x IS NOT NULL), [])")
    every = f"flatten([{', '.join(paths)}])"
    return f"SELECT report_id, {', '.join(map(new, report.TEXTS))}, array_to_string({every}, '|') AS paths FROM (SELECT *, CASE WHEN primer_bolge IS NULL THEN [] ELSE [primer_bolge] END AS cands FROM doctor_report)"


def sql() -> dict[str, str]:
    """All SQL by name."""
    layers = {name: f"SELECT ocr_id, {rules.layer_sql(k, 'text')} AS masked FROM ocr_result" for k, name in LAYERS.items() if k != "a03"}
    some = [*rules.A1, *rules.A5_FULL, *rules.A8]
    masked = rules.sql("text", some)
    place_forms = " UNION ALL ".join(f"SELECT {q(p)} AS place" for p in rules.PLACES)
    near = f"""
    WITH p AS ({place_forms}), u AS (SELECT place, {UP('place')} AS form FROM p), f AS (
      SELECT place, form FROM u WHERE length(form) >= 6 UNION SELECT place, translate(form, 'çğıöşüÇĞİÖŞÜ', 'cgiosuCGIOSU') FROM u WHERE length(form) >= 6),
    w AS (SELECT place, form, form || e AS whole, e FROM f, (SELECT unnest({listed(names.CASES)}) AS e)),
    c AS (SELECT DISTINCT ocr_id, unnest(regexp_extract_all(text, '([{LETTERS}]+)', 1)) AS token FROM ocr_result),
    t AS (SELECT * FROM c WHERE regexp_matches(token, '^[{CAPITALS}]{{6,14}}$') AND token NOT IN (SELECT form FROM f))
    SELECT DISTINCT ocr_id, token, place FROM t JOIN w ON substr(token, 1, 1) = substr(form, 1, 1)
    WHERE abs(length(token) - length(whole)) <= 1 AND ((e = '' AND @d1 <= 1) OR (length(token) >= 8 AND @d2 <= 2))"""
    # each character as one byte, since the distance counts bytes
    byte = lambda x: f"translate({x}, 'ÇĞİÖŞÜ', 'cgiosu')"
    near = near.replace("@d1", f"levenshtein({byte('token')}, {byte('form')})").replace("@d2", f"levenshtein({byte('token')}, {byte('whole')})")
    long = f"list_filter(list_transform({words_of('ad')}, lambda w: {fold('w')}), lambda w: length(w) >= 3)"
    place = f"(?:^|[^{LETTERS}])({'|'.join(rules.place_form(p) for p in sorted(rules.PLACES, key=lambda p: (-len(p), p)))}){rules.CASES}(?:$|[^{LETTERS}])"
    label = f"^[^:\\n]{{1,30}}:[ \\t]*([{CAPITALS}][{LETTERS}]{{1,19}})[ \\t]+([{CAPITALS}][{LETTERS}]{{1,19}})[ \\t]*$"
    return layers | {
        "flagship": f"SELECT engine, count(*) AS n_texts, count(*) FILTER (text <> m) AS n_changed, count(*) FILTER ({final_rule('m')} IS NOT NULL) AS n_blocked, CAST(round_even(avg(length(m)), 2) AS DOUBLE) AS mean_chars FROM (SELECT engine, text, {masked} AS m FROM ocr_result) GROUP BY engine",
        "a11_names": masked_names(),
        "a19_report_redact": redacted(),
        "a15_span_masking": overlay(),
"a17_review_mask": f"SELECT ner_id, list_reduce(list_prepend(text, list_transform({CANDIDATES}, lambda c: c)), lambda a, c, i: replace(a, c, '[KAPI_BULGUSU_' || (i - 1) || ':person]')) AS review FROM ner_result",
        "a18_judge_view": f"SELECT ner_id, regexp_replace(text, {q(MASK_TAG)}, '█', 'g') AS neutral FROM ner_result",
        "c01_fold": f"SELECT marker_id, {fold('ad')} AS low, {dotless('ad')} AS dotless, {UP('ad')} AS up FROM marker",
        "c05_ascii_fold": "SELECT marker_id, translate(ad, 'çğıöşüÇĞİÖŞÜ', 'cgiosuCGIOSU') AS plain FROM marker",
        "c07_edit_distance": f"SELECT marker_id, CAST(levenshtein({plain7('ad')}, 'kreatinin') AS INTEGER) AS distance FROM marker WHERE levenshtein({plain7('ad')}, 'kreatinin') <= 2",
        "c08_cer": (lambda n: f"SELECT ocr_id, CAST(round_even(levenshtein({n('alt_text')}, {n('text')}) / greatest(1, length({n('alt_text')})), 4) AS DOUBLE) AS cer FROM ocr_result WHERE text IS NOT NULL AND alt_text IS NOT NULL")(lambda x: f"trim(regexp_replace(regexp_replace({fold(plain7(x))}, '[ \\t]+', ' ', 'g'), '[ ]*\\n[\\n ]*', ' ', 'g'))"),
        "c10_sha": "SELECT ocr_id, sha256(text) AS sha256, CAST(length(text) AS INTEGER) AS chars FROM ocr_result",
        "c11_json_extract": "SELECT id, CASE WHEN result_json LIKE '%}%' THEN regexp_extract(result_json, '(?s)(\\{.*\\})', 1) END AS json FROM jobs",
        "c12_json_decode": "SELECT id, CASE WHEN ok THEN json_extract_string(j, '$.durum') END AS durum, CASE WHEN ok THEN CAST(json_extract(j, '$.sayfa') AS INTEGER) END AS sayfa, CASE WHEN ok THEN CAST(json_extract(j, '$.guven') AS DOUBLE) END AS guven FROM (SELECT id, json_valid(result_json) AND suffix(result_json, '}') AS ok, CASE WHEN json_valid(result_json) THEN result_json ELSE '{}' END AS j FROM jobs)",
        "c14_clamp": "SELECT report_id, CAST(round_even(CASE WHEN report_id % 7 = 0 OR guven IS NULL THEN 0.0 ELSE least(1.0, greatest(0.0, guven * 3 - 1)) END, 6) AS DOUBLE) AS confidence FROM doctor_report",
        "c15_category": f"SELECT report_id, {category('raw')} AS category FROM (SELECT report_id, coalesce(CASE report_id % 3 WHEN 0 THEN lower(replace(kategori, '_', ' ')) WHEN 1 THEN lower(kategori) || ' cancer' ELSE primer_bolge END, '') AS raw FROM doctor_report)",
        "c16_confidence": validated(),
        "c17_suffix": "SELECT id, substr(id, 1, 8) || regexp_extract(lower(filename), '(\\.[^.]+)$', 1) AS opaque FROM jobs",
        "c22_base64": "SELECT ocr_id, 'data:text/plain;base64,' || base64(encode(text)) AS address FROM ocr_result WHERE text IS NOT NULL",
        "f01_min_chars": f"SELECT ocr_id, CAST(length({BARE_TEXT}) AS INTEGER) AS chars FROM ocr_result WHERE length({BARE_TEXT}) >= 20",
        "f02_extension": "SELECT id, filename FROM jobs WHERE lower(filename) LIKE '%.pdf' OR lower(filename) LIKE '%.png' OR lower(filename) LIKE '%.jpg'",
        "f04_status": "SELECT id, filename, ref FROM jobs WHERE status = 'needs_review'",
        "f05_medical_spans": f"SELECT marker_id, coalesce(regexp_matches({fold('trim(ad)')}, {q(MARKER_FORM)}) OR (len({long}) > 0 AND len(list_filter({long}, lambda w: NOT list_contains({listed(MEDICAL_VOCABULARY)}, w))) = 0), false) AS medical FROM marker",
        "f06_finding_real": f"SELECT ner_id, CAST(pos AS INTEGER) AS pos, {is_real('c', 'text')} AS is_real FROM (SELECT ner_id, text, generate_subscripts(spans, 1) - 1 AS pos, unnest({CANDIDATES}) AS c FROM ner_result)",
        "f07_label_only": f"SELECT ocr_id, CAST(line_no AS INTEGER) AS line_no, line FROM {LINES} WHERE len({words_of('line')}) > 0 AND len(list_filter({words_of('line')}, lambda w: NOT list_contains({listed(x.replace('ı', 'i') for x in GATE_STOP)}, {dotless('w')}))) = 0",
        "f08_self_refute": f"SELECT report_id, CAST(pos AS INTEGER) AS pos, coalesce(regexp_matches({fold('b.madde')}, 'tıbbi|tibbi|medikal|pii değil|kişisel veri değil|değildir|not pii|ilaç|tanı|tetkik|ölçüm|yüzde|oran') AND NOT regexp_matches(b.kanit, '[0-9]{{7,}}'), false) AS refuted FROM (SELECT report_id, generate_subscripts(onemli_bulgular, 1) - 1 AS pos, unnest(onemli_bulgular) AS b FROM doctor_report)",
        "f09_medical_code": f"SELECT marker_id, coalesce(regexp_matches(trim(ad), '^[A-Z][0-9]{{5,7}}(?:\\.[0-9]+)?(?:$|[^0-9A-Za-z_])') OR regexp_matches(trim(ad), '^[A-Z][0-9]{{2}}(?:\\.[0-9]{{1,2}})?$') OR (regexp_matches({fold('trim(ad)')}, '(?:^|[^a-zçğıöşü])(?:analiz|panel|dizileme|test|tetkik|mutasyon|gen(?:i|ler)?|sekans|pcr|fish|ihc|immün)') AND NOT regexp_matches(ad, '[0-9]{{7,}}')), false) AS code FROM marker",
        "f10_hide_findings": "SELECT ner_id, CAST(n AS INTEGER) AS n, x.label AS type, CAST(length(x.text) AS INTEGER) AS chars, repeat('*', length(x.text)) AS shown FROM (SELECT ner_id, generate_subscripts(spans, 1) AS n, unnest(spans) AS x FROM ner_result)",
        "f12_provider_hosts": f"SELECT DISTINCT host, list_contains({listed(gate.PROVIDERS.values())}, host) AS allowed FROM egress_audit",
        "f13_final_rules": f"SELECT ocr_id, {final_rule('text')} AS rule FROM ocr_result",
        "f14_egress": f"""SELECT ner_id, len(r) = 0 AS allowed, {joined('r')} AS reasons, sha256(text) AS text_sha256, CAST(length(text) AS INTEGER) AS chars FROM (SELECT ner_id, text, list_filter([CASE WHEN NOT coalesce(len(spans) < 4, false) THEN 'kapi_gecilmedi' END,
            CASE WHEN len({remaining(CANDIDATES, 'text')}) > 0 THEN 'aday_kaldi' END, 'kural: ' || {final_rule('text')}], lambda x: x IS NOT NULL) AS r FROM ner_result WHERE text IS NOT NULL)""",
        "f15_review": f"SELECT report_id, {joined('''list_filter([CASE WHEN okunabilirlik = 'kotu' THEN 'okunabilirlik: kötü' END, CASE WHEN malignite_durumu = 'belirsiz' THEN 'malignite belirsiz' END, CASE WHEN coalesce(guven * 0.7, 0) < 0.4 THEN 'düşük güven' END, CASE WHEN len(belirsizlikler) > 0 THEN 'doğrulama uyarısı' END], lambda x: x IS NOT NULL)''')} AS reasons FROM doctor_report",
        "f17_consistency": f"SELECT report_id, {joined(contradictions('body', 'kategori', 'site'))} AS warnings FROM (SELECT report_id, kategori, coalesce(primer_bolge, '') AS site, {BODY} AS body FROM doctor_report)",
        "g01_status_counts": "SELECT status, count(*) AS n FROM jobs GROUP BY status",
        "g02_log_stats": "SELECT count(*) AS n, coalesce(CAST(round_even(avg(len(fields_removed)), 1) AS DOUBLE), 0.0) AS mean_fields, coalesce(CAST(round_even(avg(length(text)), 2) AS DOUBLE), 0.0) AS mean_chars FROM ner_result",
        "g03_distribution": "SELECT kategori, count(*) AS n, CAST(round_even(avg(guven), 3) AS DOUBLE) AS mean_confidence, CAST(round_even(sum(CASE WHEN guven >= 0.5 THEN 1.0 ELSE 0.0 END) / count(*), 3) AS DOUBLE) AS sure_rate FROM doctor_report GROUP BY kategori",
        "g04_running_mean": "SELECT report_id, kategori, CAST(round_even(avg(guven) OVER (PARTITION BY kategori ORDER BY report_id), 9) AS DOUBLE) AS running_mean FROM doctor_report WHERE guven IS NOT NULL",
        "g05_bench_summary": "SELECT engine, count(*) AS n, count(*) FILTER (coalesce(text, '') = '') AS n_empty, CAST(round_even(avg(completeness), 3) AS DOUBLE) AS mean_completeness, CAST(round_even(sum(length(text)) / greatest(1, sum(length(alt_text))), 3) AS DOUBLE) AS read_rate, CAST(round_even(avg(seconds), 2) AS DOUBLE) AS mean_seconds, count(*) FILTER (len(warnings) > 0) AS n_warned, list_sort(list(completeness) FILTER (completeness IS NOT NULL))[count(completeness) // 2 + 1] AS completeness_median FROM ocr_result GROUP BY engine",
        "g06_bench_styles": "SELECT engine, pages, grouping(engine, pages) AS level, count(*) AS n, CAST(round_even(avg(completeness), 3) AS DOUBLE) AS mean_completeness, CAST(round_even(sum(length(text)) / greatest(1, sum(length(alt_text))), 3) AS DOUBLE) AS read_rate FROM ocr_result GROUP BY GROUPING SETS ((engine), (engine, pages))",
        "g07_keyword_argmax": f"SELECT ocr_id, top.c AS category, CAST(-top.s AS INTEGER) AS score FROM (SELECT ocr_id, list_sort(list_transform({evidence('text')}, lambda r: {{'s': -len(r.keywords), 'o': r.ord, 'c': r.category}}))[1] AS top FROM ocr_result)",
        "g08_distinct_tokens": f"SELECT ocr_id, CAST(len({tokens('text')}) AS INTEGER) AS n_tokens FROM ocr_result",
        "g09_batch_summary": "SELECT count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'failed') AS n_failed, (SELECT CAST(coalesce(sum(len(fields_removed)), 0) AS BIGINT) FROM ner_result) AS n_fields FROM jobs",
        "g10_quantifiers": "SELECT host, bool_and(allowed) AS all_allowed, bool_or(allowed) AS any_allowed FROM egress_audit GROUP BY host",
        "g11_hit_counts": "SELECT ocr_id, CAST(len(regexp_extract_all(text, '[0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4}')) AS INTEGER) AS n_dates, CAST(len(regexp_extract_all(text, '[0-9]{5}/[0-9]{2}')) AS INTEGER) AS n_protocols FROM ocr_result",
        "j01_name_pairs": NAME_PAIRS,
        "j03_suffix": f"SELECT token, {' OR '.join(f'suffix(token, {q(s)})' for s in names.SUFFIXES)} AS has_ending FROM name_lexicon",
        "j04_misread_places": near,
        "j05_places": f"SELECT ocr_id, {joined(f'list_sort(list_distinct(regexp_extract_all(text, {q(place)}, 1)))')} AS places FROM ocr_result",
        "j11_labelled_names": f"SELECT ocr_id, CAST(line_no AS INTEGER) AS line_no, regexp_extract(line, {q(label)}, 1) || ' ' || regexp_extract(line, {q(label)}, 2) AS value FROM {LINES} WHERE regexp_matches(line, {q(label)}) AND {UP(f'regexp_extract(line, {q(label)}, 1)')} IN (SELECT word FROM {DICT} WHERE is_first)",
        "j06_sections": f"SELECT ocr_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (medical) AS INTEGER) AS n_medical FROM ({SECTION}) GROUP BY ocr_id",
        "j07_candidates": f"SELECT ner_id, {joined(remaining(CANDIDATES, 'text'))} AS remaining FROM ner_result WHERE text IS NOT NULL",
        "j08_keywords": f"SELECT ocr_id, e.category AS category, {joined('e.keywords')} AS keywords, CAST(len(e.keywords) AS INTEGER) AS score FROM (SELECT ocr_id, unnest({evidence('text')}) AS e FROM ocr_result)",
        "j09_cross": "SELECT DISTINCT engine, host FROM ocr_result, egress_audit",
        "j10_longest_key": f"SELECT report_id, {category('raw')} AS category FROM (SELECT report_id, coalesce(primer_bolge, '') AS raw FROM doctor_report)",
        "j12_page_zip": """
            WITH a AS (SELECT ocr_id, generate_subscripts(p, 1) - 1 AS page_no, unnest(p) AS text FROM (SELECT ocr_id, string_split(text, chr(12)) AS p FROM ocr_result)),
            b AS (SELECT ocr_id, generate_subscripts(p, 1) - 1 AS page_no, unnest(p) AS text FROM (SELECT ocr_id, string_split(alt_text, chr(12)) AS p FROM ocr_result))
            SELECT coalesce(a.ocr_id, b.ocr_id) AS ocr_id, CAST(coalesce(a.page_no, b.page_no) AS INTEGER) AS page_no, CASE WHEN coalesce(length(trim(a.text)) > 50, false) OR b.ocr_id IS NULL THEN 'katman' ELSE 'ikincil' END AS engine,
              CAST(length(CASE WHEN coalesce(length(trim(a.text)) > 50, false) OR b.ocr_id IS NULL THEN a.text ELSE b.text END) AS INTEGER) AS chars FROM a FULL OUTER JOIN b ON a.ocr_id = b.ocr_id AND a.page_no = b.page_no""",
        "c18_seconds": "SELECT id, epoch_us(date_trunc('second', created_at)) AS created_us FROM jobs",
        "s06_warnings": "SELECT ocr_id, CASE WHEN coalesce(alt_text, '') <> '' AND round_even(length(text) / length(alt_text), 2) < 0.6 THEN 'ikincil okumaya göre eksik' ELSE '' END AS warnings FROM ocr_result",
        "k01_text_files": "SELECT ner_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS bytes, text FROM ner_result WHERE text <> ''",
        "s08_landing": "SELECT ner_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS bytes FROM ner_result WHERE text <> '' AND octet_length(encode(text)) + 1 <= 1500",
        "s14_manifest": "SELECT id, kind, id || '.png' AS file, text FROM synth_case",
        "k03_log": "SELECT job_id, CAST(2 * count(*) AS BIGINT) AS n, CAST(2 * sum(len(fields_removed)) AS BIGINT) AS n_fields, CAST(2 * sum(length(text)) AS BIGINT) AS chars FROM ner_result GROUP BY job_id",
        "k04_category_stats": "SELECT kategori, count(*) AS total_count, CAST(round_even(avg(guven), 6) AS DOUBLE) AS avg_confidence FROM doctor_report GROUP BY kategori",
        "k05_egress": f"""SELECT CAST(ner_id AS VARCHAR) AS job_id, len(r) = 0 AS allowed, {joined('r')} AS reasons, sha256(text) AS text_sha256, CAST(length(text) AS INTEGER) AS chars, 'api.anthropic.com' AS host, 'm' AS model FROM (SELECT ner_id, text, list_filter([CASE WHEN text IS NULL OR NOT coalesce(len(spans) < 4, false) THEN 'kapi_gecilmedi' END,
            CASE WHEN len({remaining(CANDIDATES, 'text')}) > 0 THEN 'aday_kaldi' END, 'kural: ' || {final_rule('text')}], lambda x: x IS NOT NULL) AS r FROM ner_result)""",
        "k06_csv": "SELECT epoch_us(created_at) AS created_us, id, status, filename, ref, size_bytes FROM jobs",
        "k05_audit": "SELECT host, reason, count(*) AS n FROM (SELECT host, unnest(CASE WHEN len(reasons) = 0 OR reasons IS NULL THEN [NULL] ELSE reasons END) AS reason FROM (SELECT DISTINCT * FROM egress_audit)) GROUP BY host, reason",
        "k07_json": "SELECT report_id, CAST(to_json(list_transform(belirtecler, lambda b: b.ad)) AS VARCHAR) AS json FROM doctor_report",
        "k08_markdown": f"SELECT report_id, {markdown()} AS markdown FROM doctor_report",
        "o01_recent": "SELECT id, status, filename, ref, size_bytes FROM jobs ORDER BY created_at DESC, id LIMIT 50",
        "o02_recent_status": "SELECT id, status, filename FROM jobs WHERE status = 'failed' ORDER BY created_at DESC, id LIMIT 20",
        "o03_export": "SELECT epoch_us(ts) AS ts_us, host, allowed, text_sha256, chars FROM (SELECT DISTINCT * FROM egress_audit)",
        "o04_groups_desc": "SELECT ref, count(*) AS n FROM jobs GROUP BY ref",
        "o05_span_order": f"SELECT ner_id, {joined('''list_transform(list_sort(list_transform(spans, lambda s: {'a': s.start, 'b': s.start - s.\"end\", 'c': -s.score, 'l': s.label})), lambda k: k.a || ':' || (k.a - k.b) || ':' || k.l)''')} AS spans FROM {RAW}",
        "o06_longest_first": f"SELECT term_id, {joined('''list_transform(list_sort(list_transform(aliases, lambda a: {'n': -length(a), 'a': a})), lambda x: x.a)''')} AS aliases FROM canonical_term",
        "o07_prefixes": f"SELECT ner_id, {joined(f'{CANDIDATES}[1:2]')} AS some, left(coalesce(text, ''), 64) AS head FROM ner_result",
        "s03_resolution": "SELECT id, CAST(least(300, greatest(72, floor(sqrt(25000000.0 / ((size_bytes % 90 + 5) * (size_bytes % 110 + 7)))))) AS INTEGER) AS dpi FROM jobs",
        "s06_completeness": "SELECT ocr_id, CAST(length(CASE WHEN length(trim(text)) >= 400 THEN text ELSE coalesce(CASE WHEN length(trim(alt_text)) > 0 THEN alt_text END, text) END) AS INTEGER) AS chars, CASE WHEN alt_text IS NULL OR alt_text = '' THEN 1.0 ELSE CAST(round_even(length(text) / length(alt_text), 2) AS DOUBLE) END AS completeness, array_to_string(list_sort(list_distinct(page_engines)), '+') AS engines FROM ocr_result",
        "s10_dictionary": f"SELECT word, is_first, is_surname FROM {DICT}",
        "s12_forms": forms(),
        "t01_gate": f"SELECT n.ner_id, text IS NOT NULL AND coalesce(len({remaining(CANDIDATES, 'text')}), 0) + coalesce(r.k, 0) = 0 AS passed, CAST(coalesce(len({remaining(CANDIDATES, 'text')}), 0) + coalesce(r.k, 0) AS INTEGER) AS n_findings FROM ner_result n LEFT JOIN (SELECT ner_id, count(*) AS k FROM ({residual_union()}) GROUP BY ner_id) r ON r.ner_id = n.ner_id",
        "t02_residual": f"SELECT ner_id, type, count(*) AS n FROM ({residual_union()}) GROUP BY ner_id, type",
        "t05_cross_layer": f"SELECT ner_id, f AS finding, CASE WHEN regexp_matches(replace(f, ' ', ''), '^[{LETTERS}]+$') THEN 'person' ELSE 'id' END AS type FROM (SELECT ner_id, unnest({remaining(CANDIDATES, 'text')}) AS f FROM ner_result)",
        "u01_union": f"SELECT ner_id, {joined(f'list_sort(list_distinct(list_concat({CANDIDATES}, coalesce(fields_removed, []))))')} AS candidates FROM ner_result",
        "u02_deleted_tokens": f"SELECT ocr_id, {joined(f'list_sort(list_filter({tokens('text')}, lambda x: NOT list_contains({tokens('after')}, x) AND NOT list_contains({listed(gate.STOP_CAPITALS)}, x)))')} AS deleted FROM (SELECT ocr_id, text, {masked} AS after FROM ocr_result WHERE text IS NOT NULL)",
        "u03_all_names": "SELECT token FROM name_lexicon WHERE is_first UNION SELECT token FROM name_lexicon WHERE is_surname",
        "u04_bag": f"SELECT ocr_id, {joined('list_concat(warnings, page_engines)')} AS bag FROM ocr_result",
        "w01_bigrams": f"SELECT w1, w2, count(*) AS n FROM (SELECT word AS w1, lead(word) OVER (PARTITION BY ocr_id, line_no ORDER BY pos) AS w2 FROM {WORDS.replace('@lines', LINES)}) WHERE w2 IS NOT NULL GROUP BY w1, w2",
        "w02_header": "SELECT ocr_id, array_to_string(string_split(text, chr(10))[1:14], chr(10)) AS header FROM ocr_result",
        "w03_joined": "SELECT ocr_id, text, true AS in_place FROM ocr_result WHERE text <> ''",
        "w04_merge_spans": f"SELECT ner_id, string_agg(s || ':' || e, '|' ORDER BY s) AS merged FROM ({merged_rows()}) GROUP BY ner_id",
        "w05_ordinals": f"SELECT ner_id, CAST(generate_subscripts(spans, 1) AS INTEGER) AS n, unnest({CANDIDATES}) AS candidate FROM ner_result",
        "w06_capitals": "SELECT ocr_id, len(regexp_extract_all(text, '[A-ZÇĞİÖŞÜ]')) > len(regexp_extract_all(text, '[a-zçğıöşü]')) AS capitals FROM ocr_result WHERE text IS NOT NULL",
        "w08_latest_state": "SELECT job_id, host, allowed, text_sha256, chars FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, text_sha256 DESC, host DESC, chars DESC) AS k FROM (SELECT DISTINCT * FROM egress_audit WHERE job_id IS NOT NULL)) WHERE k = 1",
        "x04_stale": "SELECT CASE WHEN status IN ('queued', 'processing') THEN 'failed' ELSE status END AS status, count(*) AS n FROM jobs GROUP BY 1",
        "x09_stream_means": "SELECT kategori, count(*) AS total_count, CAST(round_even(avg(guven), 6) AS DOUBLE) AS avg_confidence FROM doctor_report GROUP BY kategori",
    }
