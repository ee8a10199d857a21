"""Line-first quality rules (DataFrame functions only).

Each line is judged by itself: its marks (end of sentence, share of symbols),
navigation separators, and boilerplate phrases. Lines that fail are removed;
a document that loses more than ``max_loss`` of its word characters that way
is rejected, and so is one that fails the base rules (too few words, too many
words inside repeated five-word windows). Everything is a per-row expression:
one scan, no shuffle. Windows are compared by 64-bit hashes within one text;
repeats are found by sorting them, so a long text costs n log n.

Boilerplate phrases are given for English, German, French and Spanish; lines in
other languages are judged by the other rules.

Defined cases: null, empty and blank texts have no words and fail the base
rules (fewer than ``MIN_WORDS``); equal rows get equal results; long texts are
judged whole; of the input's columns only doc_id and text are read, so no name
can clash; a text that loses exactly ``max_loss`` is kept.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOSS = 0.5
WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: the end of a sentence, in or at the end of a line, also before a closing quote or bracket
END_MARK = r"""[.!?:;…。！？]["'”’»)\]]*(\s|$)"""
#: symbols and shouting; a line with more than one in MARK_EVERY characters fails
MARKS = r"[#*$%&|<>{}=_~^\\]|!!"
MARK_EVERY = 12
#: entries between separators
SEPARATOR = r"[|»›•·]"
MIN_SEPARATORS = 3
MAX_ENTRY_CHARS = 40
#: boilerplate of pages in English, German, French and Spanish; whole words, so that a line that only speaks of such
#: things stays
PHRASES = (
    "all rights reserved", "released under the", "terms of (use|service)", "privacy policy", "cookie (policy|settings)", "(we|site) uses? cookies",
    "accept (all )?cookies", "enable javascript", "subscribe (now|to our)", "sign (in|up)", "log in", "click here", "read more", "lorem ipsum",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "verwende[nt]+ cookies", "cookies akzeptieren", "javascript aktivieren",
    "jetzt (anmelden|abonnieren)", "hier klicken", "weiterlesen",
    "tous droits réservés", "conditions d.utilisation", "politique de confidentialité", "utilis(e|ons) des cookies", "accepter (tous )?les cookies",
    "activer javascript", "se connecter", "cliquez ici", "lire la suite",
    "todos los derechos reservados", "condiciones de uso", "política de privacidad", "(usa|utiliza)(mos)? cookies", "aceptar (todas )?las cookies",
    "activar javascript", "iniciar sesión", "haga clic aquí", "leer más")
BOILERPLATE = r"(?i)(^|[^\p{L}])(" + "|".join(PHRASES) + r")($|[^\p{L}])"


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def line_fails(line: Column) -> Column:
    """The rules of one line; a blank line passes (it has nothing to lose)."""
    trimmed = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    size = F.char_length(trimmed)
    marks = F.regexp_count(trimmed, F.lit(MARKS))
    entries = F.regexp_count(trimmed, F.lit(SEPARATOR))
    return (size > 0) & (
        ~trimmed.rlike(END_MARK) | (marks * MARK_EVERY > size)
        | ((entries >= MIN_SEPARATORS) & (size < MAX_ENTRY_CHARS * (entries + 1)))
        | trimmed.rlike(BOILERPLATE))


def word_chars(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, WHITE, "")).cast("long")


def rule_results(documents: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, n_failed_lines, kept_chars,
    clean_text (the lines that pass) and kept."""
    base = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    split = base.select("doc_id", "text", words(F.col("text")).alias("w"), F.split("text", "\n").alias("lines"))
    hashed = split.select(
        "doc_id", "text", F.size("w").cast("long").alias("n_words"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
        F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("full"),
        F.filter("lines", lambda x: ~line_fails(x)).alias("good"), F.size("lines").alias("n_lines"))
    windows = hashed.select(
        "*", F.when(F.col("n_words") >= WINDOW, F.transform(
            F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")),
            lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))).alias("win"))
    repeats = windows.select(
        "*", F.when(F.size(F.array_distinct("win")) < F.size("win"),
                    F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("order"))
    starts = repeats.select("*", F.sort_array(F.transform(F.filter(
        F.transform("order", lambda p, k: F.struct(p["i"].alias("i"), (
            F.coalesce(F.get("order", k - 1)["x"] == p["x"], F.lit(False))
            | F.coalesce(F.get("order", k + 1)["x"] == p["x"], F.lit(False))).alias("again"))),
        lambda s: s["again"]), lambda s: s["i"])).alias("again"))
    covered = F.aggregate(
        "again", F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("to"), (a["n"] + i + WINDOW - F.greatest(i, a["to"])).alias("n")))["n"]
    counted = starts.select(
        "doc_id", "n_words", word_chars(F.col("text")).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.col("n_lines") - F.size("good")).cast("long").alias("n_failed_lines"),
        F.array_join("good", "\n").alias("clean_text"))
    judged = counted.select(
        "*", ((F.col("n_words") < MIN_WORDS)
              | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)).alias("base_failed"),
        word_chars(F.col("clean_text")).alias("kept_chars"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_failed_lines", "kept_chars", "clean_text",
        (~F.col("base_failed") & (F.col("kept_chars") >= F.col("word_chars") * F.lit(1 - max_loss))).alias("kept"))
