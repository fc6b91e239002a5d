"""Line-first quality rules.

Every line with a word is judged alone. It fails by

* *punctuation*: it ends without a closing mark (of any script; lines in Thai and Lao, which have
  none, are not asked for one), symbols are over a tenth of its characters,
  or over a fifth of its words carry runs of marks;
* *navigation*: three separators or more, or a phrase of a site's menu;
* *boilerplate*: a phrase of rights, terms, cookies or scripts.

Phrases are whole words, in the languages listed; a line of another language is judged by its marks.

Failing lines are removed; a document that loses more than ``MOST_LOST`` percent of its words is
rejected. Before that, a base test rejects documents of fewer than ``LEAST_WORDS`` words
or with over ``MOST_REPEATED`` percent of their words in five-word windows that occur twice.

All of it is columns over one row: no shuffle, no Python. Window hashes are compared
inside one text only; texts without a repeated window skip the part that finds places.

Defined cases: a null or empty text has no words and fails the base test; its cleaned
text is empty; repeated rows are judged alike; an empty table gives an empty table; the
columns made here replace columns of the same names, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sentiscope.llm.common import let, table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
LEAST_WORDS = 10
MOST_REPEATED = 20
MOST_LOST = 30
WINDOW = 5

# Fixed values of the line rules, in the regular expressions that Spark and DuckDB share.
# Closing marks: other, closing and final punctuation of any script but the marks that do not end a line,
# and straight quotes.
CLOSED = r"[\p{Po}\p{Pe}\p{Pf}][\x20\x09-\x0D]*$"
NOT_CLOSED = r"[,#%&*@/\x5C\x{2022}\x{00B7}\x{3001}\x{FF0C}\x{060C}][\x20\x09-\x0D]*$"
UNMARKED = r"[\x{0E01}-\x{0EDF}]"
MARKS = r"[!?]{2,}|[.]{4,}"
SEPARATORS = r"[|»›•]|>>|->"


def _phrases(*listed: str) -> str:
    """Any of the phrases as whole words."""
    return rf"(^|[^\p{{L}}\p{{N}}])({'|'.join(listed)})($|[^\p{{L}}\p{{N}}])"


NAVIGATION = _phrases(
    "skip to (main )?content", "skip to navigation", "back to top", "log ?in", "sign ?in", "sign ?up", "read more", "click here", "next page",
    "previous page", "home page", "site ?map",
    "zum inhalt springen", "nach oben", "weiterlesen", "anmelden", "registrieren", "startseite",
    "aller au contenu", "haut de page", "lire la suite", "se connecter", "s.inscrire", "plan du site",
    "ir al contenido", "volver arriba", "leer más", "iniciar sesión", "registrarse", "mapa del sitio",
    "leggi tutto", "torna su", "accedi", "leia mais", "lees verder", "inloggen")
BOILERPLATE = _phrases(
    "all rights reserved", "terms of use", "terms of service", "privacy policy",
    "cookie (policy|settings|notice|preferences|consent)", "(uses?|using|accept|accept all|manage|our) cookies",
    "(enable|disable|requires?|needs?|without) javascript", "javascript (is|must be) (disabled|enabled|required)",
    r"copyright( notice)? (\(c\)|[0-9]{4}|by)", r"(\(c\)|©) ?(copyright )?[0-9]{4}", "licen[sc]ed under", "released under", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "impressum",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d.utilisation",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "términos de uso",
    "tutti i diritti riservati", "informativa sulla privacy", "todos os direitos reservados", "alle rechten voorbehouden")


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def line_fails(line: Column) -> Column:
    low = F.lower(line)
    open_end = (~line.rlike(CLOSED) | line.rlike(NOT_CLOSED)) & ~line.rlike(UNMARKED)
    punctuation = (open_end
                   | (_count(line, SYMBOL) * 10 > F.char_length(line))
                   | (_count(line, MARKS) * 5 > _count(line, WORD)))
    navigation = (_count(line, SEPARATORS) >= 3) | low.rlike(NAVIGATION)
    return punctuation | navigation | low.rlike(BOILERPLATE)


def repeated_words(w: Column) -> Column:
    """Words in windows of ``WINDOW`` words that occur twice or more in the array."""
    def places(pairs: Column) -> Column:
        same = lambda p, i: F.coalesce(F.get(pairs, i)["h"] == p["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, lambda p, i: same(p, i - 1) | same(p, i + 1)), lambda p: p["i"]))

    def covered(starts: Column) -> Column:
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                           lambda a, s: F.struct((a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n"), s.alias("last")),
                           lambda a: a["n"])

    windows = F.when(F.size(w) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))
    pairs = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs(h), lambda p: covered(places(p))))
               .otherwise(0))


def judge(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``lost_words``, ``kept`` and ``cleaned``."""
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept", "cleaned")
    rest = F.struct(*[F.col(c) for c in docs.columns if c not in made])
    text = F.coalesce(F.col("rest.text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(
        F.size(w).alias("n"), F.aggregate(w, F.lit(0), lambda a, x: a + F.char_length(x)).alias("chars"),
        repeated_words(w).cast("long").alias("repeated")))
    d = docs.select(rest.alias("rest")).select("rest", counts.alias("counts"), lines.alias("lines"))
    d = d.select("rest", "counts.*", "lines", F.filter("lines", line_fails).alias("bad"))
    lost = F.aggregate("bad", F.lit(0), lambda a, x: a + _count(x, WORD))
    d = d.withColumn("lost", lost.cast("long"))
    failed = (F.col("n") < LEAST_WORDS) | (100 * F.col("repeated") > MOST_REPEATED * F.col("n"))
    columns = [F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c not in made]
    return d.select(
        *columns, F.col("n").cast("long").alias("n_words"), F.col("chars").cast("long").alias("word_chars"),
        _count(text, SYMBOL).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("repeated").alias("n_repeat_words"), failed.alias("base_failed"), F.col("lost").alias("lost_words"),
        (~failed & (100 * F.col("lost") <= MOST_LOST * F.col("n"))).alias("kept"),
        F.array_join(F.filter("lines", lambda x: ~line_fails(x)), "\n").alias("cleaned"))


def op6_line_quality(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept")


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
l AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
j AS (
  SELECT r, line, len(regexp_extract_all(line, '{WORD}')) AS n,
         (NOT regexp_matches(line, '{CLOSED}') OR regexp_matches(line, '{NOT_CLOSED}')) AND NOT regexp_matches(line, '{UNMARKED}')
         OR len(regexp_extract_all(line, '{SYMBOL}')) * 10 > length(line)
         OR len(regexp_extract_all(line, '{MARKS}')) * 5 > len(regexp_extract_all(line, '{WORD}'))
         OR len(regexp_extract_all(line, '{SEPARATORS}')) >= 3
         OR regexp_matches(lower(line), '{NAVIGATION}')
         OR regexp_matches(lower(line), '{BOILERPLATE}') AS bad
  FROM l WHERE len(regexp_extract_all(line, '{WORD}')) > 0),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN bad THEN n ELSE 0 END) AS lost FROM j GROUP BY r),
g AS (
  SELECT r, unnest(range(1, len(w) - 3)) AS i,
         unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS five
  FROM d WHERE len(w) >= 5),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS c FROM g),
s AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM h WHERE c > 1),
rep AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM s GROUP BY r),
x AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '{SYMBOL}')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lines.lost, 0) AS lost
  FROM d LEFT JOIN lines USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost <= {MOST_LOST} * n_words AS kept
FROM b
"""
