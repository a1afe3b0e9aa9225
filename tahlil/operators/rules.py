"""Masking layers for form-like texts: ordered rules, each replacing what identifies a person or place by a tag.

Order matters: numbers before names (a title rule would swallow a label and leave its number), dates before
slash numbers (a year after a slash is a date). A layer is applied to the whole text; a null text stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tahlil.functions.patterns import CAPITALS, LETTERS, Rule, anycase, anyof, apply, reported, sql

B = "[ \\t]*"
SEP = f"{B}[:.=]{{0,2}}{B}"
WORD = f"[{CAPITALS}][{LETTERS}]+(?:-[{CAPITALS}][{LETTERS}]+)?"
#: Words that begin the next field of a line, so that a name ends before them (fixed values).
FIELD_WORDS = ("isteyen", "gönderen", "gönd", "servis", "doktor", "dokt", "tc", "yaş", "cinsiyet", "doğum", "baba", "anne", "protokol", "rapor", "biyopsi", "dosya", "kabul", "numune", "tarih", "klinik", "tetkik", "patoloji", "hasta")
NEXT = f"(?!{anyof(*FIELD_WORDS)}(?![{LETTERS}]))(?![{LETTERS}]+{B}[:=])"
NAME = f"(?:[{CAPITALS}]\\.{B})?{WORD}(?:[ \\t]+{NEXT}[{LETTERS}]{{2,}}(?:-[{LETTERS}]+)?){{0,3}}"
NAMES = f"[{CAPITALS}][{LETTERS}.]+(?:-[{CAPITALS}][{LETTERS}]+)?(?:[ \\t]+[{CAPITALS}][{LETTERS}.]+(?:-[{CAPITALS}][{LETTERS}]+)?){{0,3}}"
NO = anyof("no", "numarası")
REF = "[0-9A-Za-z_/-]"

A1 = [
    Rule("a01", "TC Kimlik No", f"{anycase('t.c.~')}(?:{anycase('kimli')}[kKğĞ]|{anycase('kimtik')}|{anycase('k.')}){B}(?:{NO})?{SEP}[0-9*]{{7,11}}", "[TC_KIMLIK_SILINDI]"),
    Rule("a01", "Kimlik No", "[1-9][0-9]{10}", "[KIMLIK_SILINDI]", "word", "word"),
    Rule("a01", "Maskeli TC", "[0-9]{2,8}\\*{2,8}[0-9]{0,5}", "[TC_KIMLIK_SILINDI]", "word", "digit"),
]
A2 = [
    Rule("a02", name, f"{label}{SEP}{REF}+", "[REFERANS_SILINDI]", "letter")
    for name, label in (
        ("Dosya No", anycase("dosya~no")),
        ("Başvuru No", anycase("başvuru~no")),
        ("Patoloji No", f"{anycase('patoloji~')}{anyof('protokol no', 'protokol', 'no')}"),
        ("Protokol No", f"{anycase('protokol')}{B}[/\\\\]?{B}[nN][oOeE]"),
        ("Biyopsi No", anycase("biyopsi~no")),
        ("Ruhsat No", anycase("ruhsat~no")),
        ("Rapor No", anycase("rapor~no")),
        ("Defter No", anycase("defter~no")),
    )
] + [Rule("a02", "Protokol No (format)", "[A-Z]-[0-9]{4,7}/?[0-9]{0,4}", "[REFERANS_SILINDI]", "word", "word")]
TITLES = f"(?:{anyof('prof', 'uzm', 'doç', 'op', 'yrd', 'asist', 'pat', 'dr')}(?:\\.{B}|[ \\t]+))*"
DOCTOR = f"{TITLES}{NAME}"
A3 = [
    Rule("a03", "Hasta adı", f"(?:{anycase('hasta ')})?{anyof('adı soyadı', 'adı~-~soyadı', 'adı ve soyadı', 'ad soyad')}{B}[:=.]{{0,2}}{B}{NAME}", "[HASTA_ADI_SILINDI]", "letter"),
    Rule("a03", "Hasta adı", f"{anycase('hasta ')}{anycase('adı')}{B}[:=]{{1,2}}{B}{NAME}", "[HASTA_ADI_SILINDI]", "letter"),
    Rule("a03", "Hasta adı", f"{anyof('isim', 'ismi', 'adı', 'soyadı')}{B}[:=]{B}{NAME}", "[HASTA_ADI_SILINDI]", "letter"),
    Rule("a03", "Hasta adı", f"{anycase('hasta')}(?:{anycase(' yakını')})?{B}[:=]{B}{NAME}", "[HASTA_ADI_SILINDI]", "letter"),
    Rule("a03", "Hasta adı", f"{anycase('anne~adı')}{SEP}[{LETTERS}]{{2,20}}", "[HASTA_ADI_SILINDI]", "letter"),
    Rule("a03", "Doktor adı", f"{anyof('isteyen doktor', 'gönderen doktor', 'gönd.doktor', 'gönd. dokt', 'sorumlu hekim')}{SEP}{DOCTOR}", "[DOKTOR_SILINDI]", "letter"),
    Rule("a03", "Doktor adı", f"{anyof('raporlayan', 'onaylayan', 'gönderen', 'imza')}(?:[ \\t]+{anyof('doktor', 'hekim', 'patolog')})?{B}[:]{B}{DOCTOR}", "[DOKTOR_SILINDI]", "letter"),
    Rule("a03", "Doktor adı", f"{anyof('patolog', 'klinisyen', 'hekim', 'doktor', 'uzman', 'cerrah')}{B}[:=]{B}{DOCTOR}", "[DOKTOR_SILINDI]", "letter"),
    Rule("a03", "Baba adı", f"{anycase('baba~adı')}{SEP}[{LETTERS}]{{2,20}}", "[BABA_ADI_SILINDI]", "letter"),
    Rule("a03", "Doğum yeri", f"{anycase('doğum~yeri')}{SEP}[{LETTERS}]{{2,25}}", "[DOGUM_YERI_SILINDI]", "letter"),
    Rule("a03", "Doğum tarihi", f"{anyof('doğum tarihi', 'doğ.tarihi', 'doğ. tar', 'doğum')}{B}[:.]{B}[0-9][0-9./ -]{{5,18}}[0-9]", "[DOGUM_TARIHI_SILINDI]", "letter"),
    Rule("a03", "Cinsiyet/Doğum/Yaş", f"{anycase('cinsiyet~')}[/,]?{B}{anycase('doğ.~tar')}[./]?{B}[/,]?{B}{anycase('yaş')}{SEP}[^\\n]{{5,40}}", "[CINSIYET_YAS_SILINDI]", "letter"),
]
A4 = [
    Rule("a04", "Doktor adı (unvanlı)", f"{title}{NAMES}", "[DOKTOR_SILINDI]", "letter")
    for title in (
        anycase("prof.~dr.~"),
        anycase("yrd.~doç.~dr.~"),
        anycase("doç.~dr.~"),
        anycase("uzm.~dr.~"),
        anycase("op.~dr.~"),
        anycase("asist.~dr.~"),
        anycase("pat.~uzm.~"),
        f"{anycase('patolog')}[ \\t]+",
        anycase("eğitim görevlisi "),
        anycase("dr.~öğr.~üyesi "),
        f"{anycase('asistan~dr')}[:.]{B}",
        f"[dD][rR]\\.{B}",
    )
] + [
    Rule("a04", "Doktor adı", f"[dD][rR][ \\t]+{NAMES}", "[DOKTOR_SILINDI]", "letter"),
    Rule("a04", "Patoloji uzmanı", anycase("patoloji uzmanı"), "[UZMAN_SILINDI]", "letter"),
]
MONTHS = ("ocak", "şubat", "mart", "nisan", "mayıs", "haziran", "temmuz", "ağustos", "eylül", "ekim", "kasım", "aralık")
D = "[TARIH_SILINDI]"
A5_FULL = [
    Rule("a05", "gün.ay.yıl", "[0-9][0-9]?[./][0-9]{1,2}[./][0-9]{4}(?:[ \\t]+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?", D, "word", "word"),
    Rule("a05", "yıl-ay-gün", "(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}", D, "word", "word"),
    Rule("a05", "gün-ay-yıl", "[0-9][0-9]?[ \\t]*-[ \\t]*[0-9]{1,2}[ \\t]*-[ \\t]*[0-9]{4}", D, "word", "word"),
    Rule("a05", "gün,ay,yıl", "[0-9][0-9]?,[0-9]{1,2},[0-9]{4}", D, "word", "word"),
    Rule("a05", "kısa yıl", "[0-9][0-9]?[./][0-9]{1,2}[./][0-9]{2}", D, "word", "word"),
]
A5_MONTH_YEAR = Rule("a05", "ay/yıl", "(?:0[1-9]|1[0-2])/[0-9]{2}", D, "word", "word")
#: A line on which month/year is a date, and one on which it is a ratio of lymph nodes.
DATE_LINE, NODE_LINE = f"{anyof('tarih', 'kabul', 'onay', 'istem', 'rapor')}", f"{anyof('lenf', 'nod')}|/[0-9]{{2}}[ \\t]*{anyof('pozitif', 'metast', 'adet')}"
A5_REST = [
    Rule("a05", "günay/yıl", "[0-9]{4}/[0-9]{2}", D, "word", "word"),
    Rule("a05", "gün ay adı", f"[0-9]{{1,2}}[ \\t]+{anyof(*MONTHS)}", D, "word", "word"),
    Rule("a05", "ay adı ekli", f"{anyof(*MONTHS)}{anyof('da', 'de', 'ta', 'te', 'ında', 'inde')}", D, "word", "word"),
    Rule("a05", "tarih alanı", f"{anyof('rapor', 'lab geliş', 'onay', 'numune alım', 'numune kabul', 'sonuç', 'kabul', 'alındığı', 'geldiği', 'revize', 'rapor yazdırma')}[ \\t]*{anycase('tarihi')}[ \\t]*[/:]?[^\\n]{{0,50}}", "[TARIH_ALANI_SILINDI]", "letter"),
]
AGE_OF = [("[1-9]", 0)] + [(f"{t}[0-9]", max(0, 10 * t - 5)) for t in range(1, 12)]
YEARS = f"({anycase('yaş')}(?:{anyof('ındaki', 'ında', 'lı')})?)"
PLACES = tuple(
    """Adana Adıyaman Afyonkarahisar Ağrı Aksaray Amasya Ankara Antalya Ardahan Artvin Aydın Balıkesir Bartın Batman Bayburt
    Bilecik Bingöl Bitlis Bolu Burdur Bursa Çanakkale Çankırı Çorum Denizli Diyarbakır Düzce Edirne Elazığ Erzincan Erzurum
    Eskişehir Gaziantep Giresun Gümüşhane Hakkari Hatay Iğdır Isparta İstanbul İzmir Kahramanmaraş Karabük Karaman Kars Kastamonu
    Kayseri Kilis Kırıkkale Kırklareli Kırşehir Kocaeli Konya Kütahya Malatya Manisa Mardin Mersin Muğla Muş Nevşehir Niğde Ordu
    Osmaniye Rize Sakarya Samsun Siirt Sinop Sivas Şanlıurfa Şırnak Tekirdağ Tokat Trabzon Tunceli Uşak Van Yalova Yozgat Zonguldak""".split()
)  # the 81 provinces
CASES = "(?:['’]?(?:[dDtT][aAeE][nN]?|[nN][ıiİIuUüÜ][nN]|[yY][aAeE]|[lL][ıiİIuUüÜ]))?"


def place_form(name: str) -> str:
    """A province as its name or all in capitals, with or without Turkish marks; never in lower case, where it may
    be an ordinary word."""
    first, rest = name[0], name[1:]
    first = {"İ": "[İI]", "I": "[İI]", "Ç": "[ÇC]", "Ş": "[ŞS]"}.get(first, first)
    low = "".join({"ı": "[ıi]", "i": "i", "ş": "[şs]", "ğ": "[ğg]", "ç": "[çc]", "ö": "[öo]", "ü": "[üu]"}.get(c, c) for c in rest)
    high = "".join({"ı": "I", "i": "[İI]", "ş": "[ŞS]", "ğ": "[ĞG]", "ç": "[ÇC]", "ö": "[ÖO]", "ü": "[ÜU]"}.get(c, c.upper()) for c in rest)
    return f"{first}(?:{low}|{high})"


A7_WORDS = f"(?:(?:[{CAPITALS}][{LETTERS}.]*|ve|ile)[ \\t]+){{0,5}}"
A7 = [
    Rule("a07", "Kurum/hastane adı", f"[{LETTERS}]+[ \\t]+{anycase('il sağlık müdürlüğü')}", "[KURUM_SILINDI]", "letter"),
] + [
    Rule("a07", "Kurum/hastane adı", f"{A7_WORDS}{kind}(?:[ \\t]+[{CAPITALS}][{LETTERS}.]*){{0,3}}", "[KURUM_SILINDI]", "letter", "letter")
    for kind in (anyof("üniversitesi", "üniversite"), anyof("hastanesi", "hastane"), anycase("fakültesi"), "(?:Laborat[uü]var[ıi]|LABORATUVARI?)", anyof("sağlık merkezi", "sağlık müdürlüğü", "sağlık bakanlığı", "tıp merkezi"))
] + [
    Rule("a07", "T.C. satırı", "(?m:^)T[ \\t]*\\.?[ \\t]*C[. \\t][^\n]*", "[KURUM_SILINDI]"),
    Rule("a07", "Şehir", f"(?:{'|'.join(place_form(p) for p in sorted(PLACES, key=lambda p: (-len(p), p)))}){CASES}", "[SEHIR_SILINDI]", "letter", "letter"),
    Rule("a07", "Kurum adresi", f"{anycase('kurum')}-?{B}{anycase('adresi')}{SEP}[^\\n]{{5,80}}", "[KURUM_ADRES_SILINDI]", "letter"),
    Rule("a07", "Kurum web", f"{anycase('kurum web adres')}{SEP}[^\\n]{{5,80}}", "[KURUM_WEB_SILINDI]", "letter"),
]
TEL = "[ILETISIM_SILINDI]"
A8 = [
    Rule("a08", "Telefon/Faks", f"{anyof('telefon', 'tel', 'faks', 'fax', 'gsm', 'cep')}{SEP}[0-9+(][0-9 \\t()+'-]{{6,24}}", TEL, "letter"),
    Rule("a08", "Telefon/Faks", "\\(0[0-9]{3}\\)[ \\t]*[0-9][0-9 \\t-]{6,14}", TEL),
    Rule("a08", "Telefon/Faks", "0[ \\t]?\\(?5[0-9]{2}\\)?[ \\t]?[0-9]{3}[ \\t]?[0-9]{2}[ \\t]?[0-9]{2}", TEL, "word", "word"),
    Rule("a08", "Telefon/Faks", "\\+90[ \\t]?\\(?[0-9]{3}\\)?[ \\t]?[0-9]{3}[ \\t]?[0-9]{2}[ \\t]?[0-9]{2}", TEL, "", "word"),
    Rule("a08", "Telefon/Faks", "0[ \\t]?\\(?[2-4][0-9]{2}\\)?[ \\t][0-9]{3}[ \\t]?[0-9]{2}[ \\t]?[0-9]{2}", TEL, "word", "word"),
    Rule("a08", "E-posta", f"{anyof('e-posta', 'eposta', 'e-mail', 'email', 'posta')}{SEP}[^ \\t\\n@]+@[^ \\t\\n]+", "[EMAIL_SILINDI]", "letter"),
    Rule("a08", "E-posta", "[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+(?:\\.[0-9A-Za-z_-]+)*\\.[A-Za-z]{2,}", "[EMAIL_SILINDI]", "word", "word", "@"),
    Rule("a08", "Web", "(?:https?://|www\\.)[^ \\t\\n]+", "[WEB_SILINDI]"),
    Rule("a08", "Web", "[0-9A-Za-z_]+\\.(?:edu|gov|org|com)\\.tr", "[WEB_SILINDI]", "word", "word"),
    Rule("a08", "Adres", f"{anycase('adres')}[iİ]?[ \\t:.=]+[^\\n]{{10,100}}", "[ADRES_SILINDI]", "letter"),
]
# Forms that are written with other separators, and addresses by their parts: stricter than the labelled rules.
STREET = f"(?:{anyof('caddesi', 'cad.', 'sokağı', 'sokak', 'sok.', 'sk.', 'bulvarı', 'bulv.')})"
HOUSE = f"(?:[,]?[ \\t\\n]{{0,2}}(?:{anyof('no', 'daire', 'kat', 'd')}{B}[:.]?{B}[0-9]+(?:/[0-9]+)?|[0-9]{{1,4}}(?:/[0-9]+)?))"
A20 = [
    Rule("a20", "Kimlik No (ayrık)", "[1-9](?:[ .\n-]?[0-9]){10}", "[KIMLIK_SILINDI]", "word", "word"),
    Rule("a20", "Telefon (ayrık)", "(?:\\+90|0090|90|0)[ ./-]?\\(?0?[2-5][0-9]{2}\\)?[ \n./-]{0,2}[0-9]{3}[ \n./-]?[0-9]{2}[ \n./-]?[0-9]{2}", TEL, "word", "word"),
    Rule("a20", "Telefon (ayrık)", "\\(?0?[2-5][0-9]{2}\\)?[ \n-][0-9]{3}[ \n-][0-9]{2}[ \n-]?[0-9]{2}", TEL, "word", "word"),
    Rule("a20", "E-posta (ayrık)", f"[{LETTERS}0-9_.+-]+[ \\t]?(?:@|\\[[aA][tT]\\]|\\([aA][tT]\\))[ \\t\n]?[{LETTERS}0-9_-]+[ \\t\n]?(?:\\.|\\[[nN][oO][kK][tT][aA]\\]|\\([nN][oO][kK][tT][aA]\\))[ \\t\n]?[{LETTERS}]{{2,}}", "[EMAIL_SILINDI]", "word", "letter", "@|[aA][tT][\\])]"),
    Rule("a20", "Adres (mahalle)", f"[{CAPITALS}][{LETTERS}]+[ \\t\n]+{anyof('mahallesi', 'mah.')}[ \\t\n]+(?:[{LETTERS}]+|[0-9]+\\.)[ \\t\n]+{STREET}{HOUSE}*(?:,?[ \\t][{CAPITALS}][{LETTERS}]+)?", "[ADRES_SILINDI]", "letter"),
    Rule("a20", "Adres (sokak)", f"(?:[{CAPITALS}][{LETTERS}]+|[0-9]{{1,4}}\\.)[ \\t\n]+{STREET}{HOUSE}+(?:,?[ \\t][{CAPITALS}][{LETTERS}]+)?", "[ADRES_SILINDI]", "word"),
]
A9 = [Rule("a09", "Diploma tescil no", f"{anycase('dip')}[lL]?[.:-]?{B}{anycase('tescil')}{B}(?:[nNwW][oOgG])?{SEP}[0-9]*", "[DIPLOMA_SILINDI]", "letter")]
A10 = [
    Rule("a10", "İmza/güvenlik bloğu", f"(?s:{anycase('bu belge')}.*?{anycase('imzalanmıştır')}\\.?)", ""),
    Rule("a10", "İmza/güvenlik bloğu", f"(?s:{anycase('bu bilgiler')}.*?{anycase('kullanılamaz')}\\.?)", ""),
]
A12 = [
    Rule("a12", "İşlem No", f"{anycase('işlem~')}(?:{NO})?[ \\t:.]*[0-9]{{5,15}}", "[ISLEM_NO_SILINDI]", "letter"),
    Rule("a12", "Protokol no", "[0-9]{4,6}/[0-9]{2,4}", "[PROTOKOL_SILINDI]", "word", "word"),
]
A13 = [
    Rule("a13", "etiketler", "(?:\\[[A-Za-z0-9_]+\\][ \\t\\n]*){4,}", "[COKLU_ALAN_SILINDI]\n"),
    Rule("a13", "boş satırlar", "\n{4,}", "\n\n\n"),
    Rule("a13", "satır sonu", "[ \\t]+\n", "\n"),
    Rule("a13", "başta ve sonda", "^[ \\t\\n]+|[ \\t\\n]+$", ""),
]
LAYERS = {"a01": A1, "a02": A2, "a03": A3, "a04": A4, "a07": A7, "a08": A8, "a09": A9, "a10": A10, "a12": A12, "a13": A13, "a20": A20}


def dates(c: Column) -> Column:
    """Dates of all forms; month/year only on lines with a date word and without lymph nodes."""
    c = apply(c, A5_FULL)
    line = lambda x: F.when(x.rlike(DATE_LINE) & ~x.rlike(NODE_LINE), apply(x, [A5_MONTH_YEAR])).otherwise(x)
    return apply(F.array_join(F.transform(F.split(c, "\n", -1), line), "\n"), A5_REST)


def dates_sql(text: str) -> str:
    """The DuckDB expression of `dates`."""
    q = lambda p: p.replace("'", "''")
    line = f"CASE WHEN regexp_matches(x, '{q(DATE_LINE)}') AND NOT regexp_matches(x, '{q(NODE_LINE)}') THEN {sql('x', [A5_MONTH_YEAR])} ELSE x END"
    return sql(f"array_to_string(list_transform(string_split({sql(text, A5_FULL)}, chr(10)), lambda x: {line}), chr(10))", A5_REST)


LABELLED_AGE = f"(?s)^(.*?)((?:^|[^{LETTERS}])){anycase('yaş')}([ıiİI]?{B}[-/,]?{B}(?:{anycase('cinsiyet')}[iİ]?)?{SEP})([0-9]{{1,3}})(?:[ \\t]*[-/][ \\t]*([EKMFekmf]))?"


def ages(c: Column) -> Column:
    """Ages as ranges of ten years: after a label only the first, in the text all. 0, and 120 or more, stay."""
    for digits, low in AGE_OF:
        tag = f"[YAS_ARALIGI: {low}-{low + 9}]"
        c = F.regexp_replace(c, F.lit(f"{digits[0] if digits[0] != '[' else digits}(?<![{LETTERS}0-9_].){digits[1:] if digits[0] != '[' else ''}[ \\t]*{YEARS}(?![{LETTERS}0-9_])"), F.lit(f"{tag} $1"))
    part = lambda k: F.regexp_extract(c, LABELLED_AGE, k)
    n = F.when(part(4) != "", part(4).cast("int"))
    low = F.greatest(F.lit(0), F.floor(n / 10) * 10 - 5).cast("int")
    sex = F.when(part(5) != "", F.concat(F.lit(" / "), F.upper(part(5)))).otherwise(F.lit(""))
    tag = F.concat(F.lit("[YAS_ARALIGI: "), low.cast("string"), F.lit("-"), (low + 9).cast("string"), F.lit("]"), sex)
    rest = F.substr(c, F.length(part(0)) + 1)
    return F.when((n > 0) & (n < 120), F.concat(part(1), part(2), tag, rest)).otherwise(c)


def ages_sql(text: str) -> str:
    """The DuckDB expression of `ages`; the text is used several times, so it should be a column."""
    for digits, low in AGE_OF:
        for _ in range(2):
            text = f"regexp_replace({text}, '(^|[^{LETTERS}0-9_]){digits}[ \\t]*{YEARS}($|[^{LETTERS}0-9_])', '\\1[YAS_ARALIGI: {low}-{low + 9}] \\2\\3', 'g')"
    part = lambda k: f"regexp_extract(x, '{LABELLED_AGE}', {k})"
    n = f"TRY_CAST({part(4)} AS INTEGER)"
    low = f"greatest(0, ({n} // 10) * 10 - 5)"
    new = f"{part(1)} || {part(2)} || '[YAS_ARALIGI: ' || {low} || '-' || ({low} + 9) || ']' || CASE WHEN {part(5)} <> '' THEN ' / ' || upper({part(5)}) ELSE '' END || substr(x, length({part(0)}) + 1)"
    return f"list_transform([{text}], lambda x: CASE WHEN {n} > 0 AND {n} < 120 THEN {new} ELSE x END)[1]"


def layer(name: str, c: Column) -> Column:
    """One layer by its name."""
    return dates(c) if name == "a05" else ages(c) if name == "a06" else apply(c, LAYERS[name])


def layer_sql(name: str, text: str) -> str:
    """The DuckDB expression of a layer."""
    return dates_sql(text) if name == "a05" else ages_sql(text) if name == "a06" else sql(text, LAYERS[name])


ORDER = ("a01", "a02", "a03", "a09", "a04", "a05", "a06", "a20", "a07", "a08", "a10", "a12", "a13")


def masked(df: DataFrame, text: str = "text", out: str = "masked", remove_dates: bool = True, generalize_age: bool = True, remove_institutions: bool = True, strict: bool = True, layers: tuple[str, ...] = ORDER) -> DataFrame:
    """`df` with the masked text in `out` and the names of the rules that applied in `fields_removed`.

    Each layer is a projection of its own, so that its text is computed once for the rules and the report. Null
    stays null and reports nothing. `strict` adds the forms with other separators and addresses by their parts. Columns `out` and `fields_removed` of `df` are replaced. `layers` are those to apply, for
    steps between them that are no rules (`operators.engine`).
    """
    off = {"a05": not remove_dates, "a06": not generalize_age, "a07": not remove_institutions, "a20": not strict}
    df = df.withColumn("__t", F.col(text)).withColumn("__f", F.array().cast("array<string>"))
    for name in layers:
        if off.get(name):
            continue
        rules = [*A5_FULL, *A5_REST] if name == "a05" else LAYERS.get(name, [])
        df = df.withColumn("__n", layer(name, F.col("__t")))
        if rules and name != "a13":
            # rules are only asked one by one where their layer has changed the text
            df = df.withColumn("__f", F.when(F.col("__n") != F.col("__t"), F.array_union("__f", reported(F.col("__t"), rules))).otherwise(F.col("__f")))
        df = df.withColumn("__t", F.col("__n"))
    return df.withColumn(out, F.col("__t")).withColumn("fields_removed", F.col("__f")).drop("__t", "__n", "__f")
