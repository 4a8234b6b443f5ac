"""Quality rules, line first: each line is judged, failing lines go, and a document that loses too much text is rejected.

Built of DataFrame functions only. Everything is decided within a row, so there is no shuffle and no key that could be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import BLANKS, SPACE, WORD, let, table

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

#: Phrases of site furniture by language; a short line that holds one, as whole words, is boilerplate.
BOILERPLATE = {
    "en": (
        "all rights reserved",
        "copyright",
        "cookies?",
        "javascript",
        "lorem ipsum",
        "privacy policy",
        "terms of use",
        "terms of service",
        "click here",
        "sign up",
        "log in",
        "subscribe to",
    ),
    "fr": ("tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "cliquez ici", "se connecter"),
    "de": ("alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "impressum", "hier klicken", "jetzt anmelden"),
    "es": ("todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal", "haga clic aquí", "iniciar sesión"),
}
#: Characters of a line that a phrase can fail: prose that mentions one is longer.
SHORT = 120
TERMINAL = r"""[.!?…:;,"'”»)\]]$"""


def repeated_words(words: Column) -> Column:
    """The number of words that lie in 8-word windows found twice or more, first included.

    Windows are compared by 64-bit hashes. A text whose window hashes are all different, as most are, ends at a hash-set
    test; the others sort their hashes once and sweep over the repeated windows' places: n log n for any text.
    """

    def windows(h: Column) -> Column:
        n = F.size(h)
        hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))

    def covered(places: Column) -> Column:
        return F.aggregate(
            F.sort_array(places),
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total")),
            lambda a, i: F.struct((i + WINDOW).alias("end"), (a["total"] + i + WINDOW - F.greatest(a["end"], i)).cast("long").alias("total")),
            lambda a: a["total"],
        )

    def sweep(s: Column) -> Column:
        same = lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])
        return covered(F.transform(F.filter(s, same), lambda e: e["i"]))

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(placed, sweep))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), count))


def removed(text: Column, characters: str) -> Column:
    """The text without these characters."""
    return F.translate(text, characters, "")


def boilerplate_pattern(phrases: dict[str, tuple[str, ...]]) -> str:
    """The phrases of all languages between what is no letter; it matches lower-cased text in Java and in RE2."""
    return r"(?:^|[^\p{L}])(?:" + "|".join(p for own in phrases.values() for p in own) + r")(?:$|[^\p{L}])"


def line_fails(line: Column, phrases: dict[str, tuple[str, ...]] = BOILERPLATE) -> Column:
    """True if the line is navigation, boilerplate, symbols, shouting, or a short fragment that no mark ends."""
    length = F.length(line)
    words = F.size(F.split(line, f"[{SPACE}]+"))
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
    navigation = (length - F.length(removed(line, "|»›•"))) >= 3
    boilerplate = (length <= SHORT) & F.lower(line).rlike(boilerplate_pattern(phrases))
    symbols = 20 * (length - F.length(removed(line, SYMBOLS + "!"))) > length
    shouting = (letters >= 20) & (10 * capitals > 7 * letters)
    fragment = (words < 4) & ~line.rlike(TERMINAL)
    return navigation | boilerplate | symbols | shouting | fragment


def clean_lines(text: Column, max_lost: float = 0.5, phrases: dict[str, tuple[str, ...]] = BOILERPLATE) -> dict[str, Column]:
    """The line-first verdict of a text.

    Returns cleaned (the lines that pass, joined), lost_chars (word characters in failing lines) and passes (at most
    max_lost of the word characters are lost). Lines without a word are never judged and stay.
    """
    trimmed = lambda line: F.btrim(line, F.lit(BLANKS))
    bad = lambda line: let(trimmed(line), lambda t: (t != "") & line_fails(t, phrases))
    judged = F.transform(F.split(text, "\n", -1), lambda line: F.struct(line.alias("line"), bad(line).alias("bad")))
    solid = lambda t: F.length(F.regexp_replace(t, f"[{SPACE}]+", "")).cast("long")
    lost = lambda j: F.aggregate(F.filter(j, lambda x: x["bad"]), F.lit(0).cast("long"), lambda a, x: a + solid(x["line"]))
    both = let(
        judged,
        lambda j: F.struct(
            F.array_join(F.transform(F.filter(j, lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("cleaned"),
            lost(j).alias("lost_chars"),
        ),
    )
    return {"line_verdict": both, "max_lost": F.lit(max_lost)}


def quality_rules(docs: DataFrame, max_lost: float = 0.5, phrases: dict[str, tuple[str, ...]] = BOILERPLATE) -> DataFrame:
    """Base counts, the base verdict and the line-first verdict of every document.

    docs: doc_id, text; other columns are not read, so their names can't clash. Null and empty texts have no words: all
    counts are 0, base_failed is true, kept is false. Repeated rows and ids give a row each. Returns doc_id, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, cleaned (the text of the lines that
    pass), kept. phrases: patterns of boilerplate by language; all languages are looked for in every text.
    """
    text = F.col("text")
    line_has_word = lambda line: line.rlike(f"[^{SPACE}]")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lines = let(F.filter(F.split(text, "\n", -1), line_has_word), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    told = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    verdict = clean_lines(text, max_lost, phrases)
    rows = rows.select(
        "doc_id",
        told.alias("told"),
        F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(removed(text, SYMBOLS))).cast("long").alias("n_symbols"),
        lines.alias("n_dup_lines"),
        verdict["line_verdict"].alias("lines"),
    )
    failed = (F.col("told.n_words") < MIN_WORDS) | (100 * F.col("told.n_repeat_words") > MAX_REPEATED_PERCENT * F.col("told.n_words"))
    lasting = F.col("lines.lost_chars") <= verdict["max_lost"] * F.col("word_chars")
    return rows.select(
        "doc_id",
        F.col("told.n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("told.n_repeat_words"),
        failed.alias("base_failed"),
        F.col("lines.lost_chars"),
        F.col("lines.cleaned"),
        (~failed & lasting).alias("kept"),
    )


def query(spark, sf_dir) -> DataFrame:
    """Query op6: the rules over all documents."""
    return quality_rules(table(spark, sf_dir, "documents")).drop("cleaned")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
often AS (SELECT rid, w FROM win GROUP BY rid, w HAVING count(*) > 1),
cover AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS j FROM win SEMI JOIN often USING (rid, w)) GROUP BY rid),
lines AS (SELECT rid, line, trim(line, E' \t\n\x0b\f\r') AS t FROM (SELECT rid, unnest(string_split(text, E'\n')) AS line FROM d)),
judged AS (
  SELECT rid, line,
         length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS solid,
         t <> '' AND (
           length(t) - length(translate(t, '|»›•', '')) >= 3
           OR (length(t) <= {short} AND regexp_matches(lower(t), '{boilerplate}'))
           OR 20 * (length(t) - length(translate(t, '#*$%&|<>!', ''))) > length(t)
           OR (length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) >= 20
               AND 10 * length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) > 7 * length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')))
           OR (len(string_split_regex(t, '[\x20\x09-\x0D]+')) < 4 AND NOT regexp_matches(t, '[.!?…:;,"''”»)\]]$'))) AS bad
  FROM lines),
lost AS (
  SELECT rid, CAST(coalesce(sum(solid) FILTER (WHERE bad), 0) AS BIGINT) AS lost_chars, CAST(sum(solid) AS BIGINT) AS word_chars,
         count(*) FILTER (WHERE solid > 0) - count(DISTINCT line) FILTER (WHERE solid > 0) AS n_dup_lines
  FROM judged GROUP BY rid),
c AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, lost_chars
  FROM d JOIN lost USING (rid) LEFT JOIN cover USING (rid))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_chars <= 0.5 * word_chars AS kept
FROM c
""".format(boilerplate=boilerplate_pattern(BOILERPLATE).replace("'", "''"), short=SHORT)
