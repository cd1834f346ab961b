"""Problem 4: broken prompt and response pairs.

Ordered rules, all of them Spark expressions, so a row never leaves the JVM. Each rule sees the
answer with width, quotes and white space made alike. Every triggered defect comes out; p4_found
keeps the first in the order empty, refusal, copy, language, truncated.

Endings are judged with counts over the whole corpus of questions and answers: how often a word
stands inside a text and how often before a stop, and which letters begin longer words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import LLM
from tallymill.llm.keys import one_width
from tallymill.session import cut
from tallymill.sources.tables import table

ORDER = ("empty", "refusal", "copy", "language", "truncated")

# Frequent function words of the four languages.
FUNCTION_WORDS = {
    "en": "the a an this that these those each every one some any my your his her its our their and or but nor so yet if of in on at to for from with by into under over near about along after before during until while because although when where which who whom whose what is was are were be been being has have had do does did it they he she we you i not as than then there would could should will",
    "de": "der die das den dem des ein eine einen einem einer eines dieser diese dieses jeder jede jedes und oder aber denn sondern wenn als weil dass ob obwohl während nachdem bevor in im an am auf aus bei beim mit nach von vom vor zu zum zur für gegen ohne um durch über unter zwischen neben ist war sind waren wird wurde hat hatte nicht es er sie wir ich wer wie wo warum welche welcher welchem sich",
    "fr": "le la les l un une des du de d au aux ce cet cette ces mon ma ses son sa leur et ou mais donc ni car si que qui quoi dont où quand comme parce puisque lorsque pendant après avant sans avec pour par sur sous dans en entre vers chez près est était sont étaient a ont avait il elle ils elles on nous vous je ne pas se s c n y",
    "es": "el la los las un una unos unas lo del de al a este esta estos estas ese esa aquel su sus mi y e o u pero sino ni si que quien cual cuyo donde cuando como porque aunque mientras durante después antes sin con para por sobre bajo en entre hacia hasta desde es era fue son eran ha han había se no él ella ellos ellas nosotros yo le les",
}
LANGUAGES = tuple(FUNCTION_WORDS)

# Words after which no sentence, list entry or phrase can end.
OPEN_WORDS = {
    "en": "the a an this that these those each every my your his her its our their and or but nor of in on at to for from with by into under near along during until while because although when which whose than as one",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber denn weil dass obwohl während nachdem bevor in im am auf aus bei beim mit nach von vom vor zu zum zur für gegen ohne durch unter neben",
    "fr": "le la les l un une des du de d au aux ce cet cette ces et ou mais donc ni car que qui dont quand parce puisque lorsque pendant avec pour par sur sous dans en entre vers chez",
    "es": "el la los las un una unos unas del de al a este esta su sus y e o u pero que cuyo cuando porque aunque mientras durante con para por sobre bajo en entre hacia hasta desde",
}

# Lead-ins, in the four languages.
LEAD_LABELS = "final answer|answer|response|question|you asked|q|a|endgültige antwort|antwort|frage|du hast gefragt|sie fragten|réponse finale|réponse|question|vous avez demandé|respuesta final|respuesta|pregunta|usted preguntó|preguntaste"
LEAD_PHRASES = "the (?:final |correct )?answer (?:is|was)|my answer is|it (?:is|was)|it's|that (?:is|was|would be)|(?:die|meine) antwort (?:ist|lautet)|das (?:ist|war|wäre)|es (?:ist|war)|la réponse (?:est|était)|ma réponse est|c ?'?est|c ?'?était|il s ?'?agit de|(?:la|mi) respuesta (?:es|era)|se trata de|es|fue|era"

LEAD_WORDS = 8  # no phrase above has more words

# What people say before, in and after a refusal.
POLITE = r"(?:(?:i ?'? ?a?m (?:very |really |so |truly )?sorry|(?:so |very )?sorry|i (?:do |must )?apologi[sz]e|(?:my )?apologies|unfortunately|regrettably|honestly|frankly|as an? (?:ai |large )*(?:language model|model|assistant|ai)|es tut mir (?:sehr |wirklich )?leid|tut mir (?:sehr )?leid|leider|bedauerlicherweise|ehrlich gesagt|entschuldigung|als (?:ki|sprachmodell|ki-sprachmodell|assistent)|je suis (?:vraiment |sincèrement )?désolée?|désolée?|malheureusement|honnêtement|en tant que (?:modèle de langue|modèle de langage|assistant|ia)|lo siento(?: mucho)?|lo lamento|lamentablemente|desafortunadamente|por desgracia|sinceramente|como (?:modelo de lenguaje|asistente|ia))[\s,;:.!]*(?:(?:but|aber|mais|pero|und|and)\b[\s,]*)?)*"
REFUSALS = (
    # en
    r"i (?:really |simply |just |honestly )?(?:do not|don't|dont|do n't) (?:know|have|wish|want|feel)\b",
    r"i (?:really |simply |just )?(?:cannot|can't|cant|can not|could not|couldn't|won't|will not|shouldn't|should not) (?:\w+ )?(?:help|assist|answer|verify|confirm|provide|give|tell|say|determine|find|respond|comment|know|share|offer|guess|decide)",
    r"(?:i am|i'm|im) (?:unable|not able|not in a position|not sure|not allowed|not permitted)",
    r"i (?:would|'d|d) (?:rather|prefer) not",
    r"i'd (?:rather|prefer) not|i'd prefer to not",
    r"i (?:have|need|must|choose) to (?:decline|refuse|pass)|i (?:must )?(?:decline|refuse)\b",
    r"i have no (?:idea|answer|information|way|knowledge|data)|no idea\b",
    r"there(?:'s| is) no (?:way|information|answer)\b",
    r"nothing (?:available|known|i have)",
    r"(?:that|this|it) (?:is|'s)? ?(?:not|isn't) (?:something|possible|known)|(?:that|this|it) isn't (?:something|possible|known)",
    r"it(?:'s| is) (?:impossible|not possible|unknown)|(?:not enough|insufficient) information",
    # de
    r"(?:das |es )?wei(?:ß|ss) ich (?:das |es |leider )?nicht|ich wei(?:ß|ss) (?:es |das |leider |die antwort )*nicht|(?:das )?ist mir (?:nicht|un)\s?bekannt",
    r"(?:das |dazu |dabei )?(?:kann|darf|möchte|will) ich\b.*\bnicht|ich (?:kann|darf|möchte|will)\b.*\bnicht",
    r"(?:dazu )?fehlen mir|mir fehlen|lässt sich\b.*\bnicht|ich habe (?:dazu )?(?:keine|nicht)|dazu habe ich keine|keine ahnung|ich rate (?:lieber )?nicht|das muss ich ablehnen|ich muss (?:das )?ablehnen",
    # fr
    r"je ne (?:le |la |les )?(?:sais|connais|peux|dispose|puis|suis pas|souhaite|veux|possède)|je (?:préfère|préférerais|dois) (?:ne pas|m'abstenir|décliner|refuser)",
    r"je n ?' ?ai (?:pas|aucune)|il (?:m ?' ?est|est|me semble) impossible|impossible de|aucune idée|cela m ?' ?est inconnu|j ?' ?ignore",
    # es
    r"no (?:lo |la |le )?(?:puedo|sé|conozco|tengo|dispongo|poseo|soy capaz|estoy seguro|quiero|es posible)|prefiero no|preferiría no|me (?:resulta|es) imposible|es imposible|desconozco|ignoro|ni idea|debo (?:declinar|rechazar)|me niego",
)
CONTRAST = r"[,;.]\s*(?:but|though|although|yet|however|still|aber|doch|jedoch|mais|cependant|toutefois|pero|aunque|sin embargo)\b"
GIVES = r"\b(?:the answer (?:is|was)|die antwort (?:ist|lautet)|la réponse est|la respuesta es)\b"

BROKEN_RATE, SMOOTH = 0.002, 3  # a word this rare beside a longer one that begins with it is broken off; both rates are smoothed
FINAL_RATE, SMOOTH_FINAL = 0.001, 0.2  # a word that stands before a stop this rarely can't end a sentence
RAN_OUT = 2  # the rates are so much larger where the generation ran out of tokens
RAN_OUT_REASONS = ("length", "max_tokens", "max_length")
LEAST_WORDS = 4  # words from which a text's last word is looked at that way


def _words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", " "), " "), lambda w: w != "")


def _among(w: Column, words: str) -> Column:
    """A hash lookup: an IN over literals becomes a set."""
    return w.isin(*dict.fromkeys(words.split()))


def normal(c: Column) -> Column:
    """One width, one kind of space, apostrophe and quote; unseen characters and tags dropped."""
    raw = F.coalesce(c, F.lit(""))
    c = one_width(raw)
    c = F.regexp_replace(c, r"(?i)&nbsp;|<br\s*/?>", " ")
    c = F.regexp_replace(c, r"</?\p{Alpha}[^<>]*+>", "")
    c = F.regexp_replace(c, r"[\p{Z}\t\x0B\f\x85\u2800\u3164]", " ")
    c = F.regexp_replace(c, r"[\p{C}&&[^\n\r]]|[\u034F\u115F\u1160\u17B4\u17B5\u180B-\u180F\uFE00-\uFE0F]", "")
    c = F.translate(c, "’‘‛`´“”„‟«»…", "'''''\"\"\"\"\"\"" + "…")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    # Most texts hold none of the characters above and stay as they are.
    return F.when(raw.rlike(r"[^\x20-\x7E\n]|[<&`]"), c).otherwise(raw)


def _without_lead(c: Column) -> Column:
    """Without labels at either end; every label ends with a colon."""
    short = F.regexp_replace(c, rf"(?is)^(?:[^\p{{L}}\p{{N}}]*(?:{LEAD_LABELS})\s*:)+", "")
    short = F.regexp_replace(short, rf"(?is)(?:\s*\b(?:{LEAD_LABELS})\s*:[^\p{{L}}\p{{N}}]*)+$", "")
    return F.when(c.contains(":"), short).otherwise(c)


def _unquoted(c: Column) -> Column:
    """Without quoted passages: names and titles may be foreign, and others may be cited."""
    bare = F.regexp_replace(c, r'"[^"\n]*+"', " ")
    bare = F.regexp_replace(bare, r"(?<![\p{L}\p{N}])'[^'\n]*+(?:(?<=\p{L})'(?=\p{L})[^'\n]*+)*+'(?![\p{L}\p{N}])", " ")
    return F.when(c.contains('"') | c.contains("'"), bare).otherwise(c)


def _hits(words: Column, of: str) -> Column:
    """How many words are among the given ones."""
    return F.size(F.filter(words, lambda w: _among(w, of)))


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def pairs(answers: DataFrame) -> DataFrame:
    """Distinct gen_id, question, answer with the forms that the rules look at."""
    reason = F.col("finish_reason") if "finish_reason" in answers.columns else F.lit(None).cast("string")
    rows = answers.select("gen_id", "question", "answer", F.coalesce(F.lower(F.trim(reason)).isin(*RAN_OUT_REASONS), F.lit(False)).alias("ran_out"))
    rows = rows.filter("gen_id is not null").distinct()
    rows = rows.withColumn("q", F.trim(normal(F.col("question")))).withColumn("a", normal(F.col("answer")))
    rows = rows.withColumn("body", _without_lead(F.col("a"))).withColumn("end", F.rtrim(F.regexp_replace("a", r"\s+$", "")))
    rows = rows.withColumn("qw", _words(F.col("q"))).withColumn("aw", _words(F.col("body")))
    return rows.withColumn("plain", F.lower(F.trim(F.regexp_replace(_unquoted(F.col("body")), r"\s+", " "))))


def is_empty() -> Column:
    bare = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}']+", " "))
    only_label = F.col("a").contains(":") & bare(F.col("a")).rlike(rf"^(?:(?:{LEAD_LABELS})\s*)+$")
    lead = (F.size("aw") <= LEAD_WORDS) & bare(F.col("body")).rlike(rf"^(?:{LEAD_PHRASES})$")
    return ~F.col("body").rlike(r"[\p{L}\p{N}]") | only_label | lead


def _refusal_columns(rows: DataFrame) -> DataFrame:
    """tail: what follows a contrast, in its own case, of texts that begin with a refusal's words; else null."""
    raw = F.trim(F.regexp_replace(_unquoted(F.col("body")), r"\s+", " "))
    refuses = F.col("plain").rlike(rf"^(?>[^\p{{L}}]*{POLITE})(?:" + "|".join(f"(?:{r})" for r in REFUSALS) + ")")
    tail = F.regexp_extract(F.regexp_replace(raw, rf"(?i)^[^\p{{L}}]*{POLITE}", ""), rf"(?i){CONTRAST}(.*)$", 1)
    return rows.withColumn("tail", F.when(refuses, tail))


def is_refusal() -> Column:
    """A refusal's words begin the text, and no answer is given after a contrast (a number or a name)."""
    answered = F.col("tail").rlike(r"\p{N}|(?<=[\p{L},] )\p{Lu}\p{Ll}+") | F.col("plain").rlike(GIVES)
    return F.col("tail").isNotNull() & ~answered


def _copy_columns(rows: DataFrame) -> DataFrame:
    """front, back: words that agree from either end with the question, repeated as often as it takes."""
    n, m = F.size("qw"), F.size("aw")
    times = F.greatest(F.lit(1), F.ceil((m - 1) / F.greatest(n, F.lit(1)))).cast("int")
    rep = F.flatten(F.array_repeat("qw", F.least(times, F.lit(1) + F.floor(m / F.greatest(n, F.lit(1))).cast("int"))))

    def lead(x: Column, y: Column) -> Column:
        same = F.zip_with(x, y, lambda s, t: F.coalesce(s == t, F.lit(False)))
        at = F.array_position(same, False)
        return F.when(at == 0, F.size(same)).otherwise(at - 1)

    # Only an answer that begins or ends as the question does can be a copy of it.
    near = (n >= 4) & (m >= 3) & ((F.get("aw", F.lit(0)) == F.get("qw", F.lit(0))) | (F.get("aw", m - 1) == F.get("qw", n - 1)))
    rows = rows.withColumn("rep", F.when(near, rep))
    return rows.withColumn("front", lead(F.col("aw"), F.col("rep"))).withColumn("back", lead(F.reverse("aw"), F.reverse("rep")))


def is_copy() -> Column:
    """No more than the question, up to one word; a word more at the very end is an answer if it is a name or a number."""
    n, m, size = F.size("qw"), F.size("aw"), F.size("rep")
    front, back = F.col("front"), F.col("back")
    last = F.regexp_extract(F.col("body"), r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1)
    more = (m == size + 1) & (front + back >= size) & ~((front == size) & last.rlike(r"^[\p{Lu}\p{N}]"))
    other = (m == size) & (front + back >= size - 1)
    less = (m == size - 1) & (front + back >= size - 1)
    cyclic = (m >= n) & (front == m)
    return F.col("rep").isNotNull() & (other | less | more | cyclic)


def is_language() -> Column:
    """The answer's language leads the question's by two function words, one of them found in no other."""
    wrong = []
    for k in LANGUAGES:
        others = set(" ".join(FUNCTION_WORDS[x] for x in LANGUAGES if x != k).split())
        own = " ".join(w for w in dict.fromkeys(FUNCTION_WORDS[k].split()) if w not in others)
        wrong.append((F.col("ql") != k) & (F.col(f"a_{k}") >= F.col("a_own") + 2) & (_hits(F.col("pf"), own) >= 1))
    return _any(wrong) | F.col("script_differs")


def _language_columns(rows: DataFrame) -> DataFrame:
    """ql: the question's language; a_en …: function words of each in the answer, a_own those of ql."""
    every = " ".join(FUNCTION_WORDS.values())
    functional = lambda words: F.filter(words, lambda w: _among(w, every))
    out = rows.withColumn("qf", functional(F.col("qw"))).withColumn("pf", functional(_words(F.col("plain"))))
    for k in LANGUAGES:
        out = out.withColumn(f"q_{k}", _hits(F.col("qf"), FUNCTION_WORDS[k])).withColumn(f"a_{k}", _hits(F.col("pf"), FUNCTION_WORDS[k]))
    best = F.greatest(*[F.col(f"q_{k}") for k in LANGUAGES])
    ql = F.when(best == 0, F.lit(None))
    ql = ql.when(F.col("q").contains("¿"), F.lit("es"))
    for k in LANGUAGES:
        ql = ql.when(F.col(f"q_{k}") == best, F.lit(k))
    out = out.withColumn("ql", ql)
    own = F.coalesce(*[F.when(F.col("ql") == k, F.col(f"a_{k}")) for k in LANGUAGES], F.lit(999))
    latin = lambda c: F.length(F.regexp_replace(c, r"[^\p{IsLatin}]", ""))
    letters = lambda c: F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    share = lambda c: latin(c) / F.greatest(letters(c), F.lit(1))
    foreign = r"[\p{L}&&[^\p{IsLatin}]]"  # without such letters both shares are 1
    has = lambda c: c.rlike(r"[^\x00-\x7F]") & c.rlike(foreign)
    differs = (has(F.col("plain")) | has(F.col("q"))) & (letters(F.col("plain")) >= 4) & (letters(F.col("q")) >= 4) & (F.abs(share(F.col("plain")) - share(F.col("q"))) > 0.7)
    return out.withColumn("a_own", own).withColumn("script_differs", differs)


def endings(rows: DataFrame, lengths: list[int]) -> tuple[DataFrame, DataFrame]:
    """(word, seen, final) of all texts, and (stem, goes_on) of beginnings of words."""
    text = rows.select(F.explode(F.array("q", "a")).alias("t"))
    tokens = F.split(F.lower("t"), r"[^\p{L}\p{M}.!?]+")
    words = text.select(F.explode(F.slice(tokens, F.lit(1), F.greatest(F.lit(0), F.size(tokens) - 1))).alias("w"))  # all but the last
    stop = F.endswith("w", F.lit(".")) | F.endswith("w", F.lit("!")) | F.endswith("w", F.lit("?"))
    words = words.select(F.translate("w", ".!?", "").alias("word"), stop.cast("long").alias("f")).filter("word <> ''")
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("seen"), F.sum("f").alias("final"))
    counts = cut(counts, "words")
    # Of each beginning, how often the most frequent word that goes on from it is seen. Beginnings are
    # taken at the lengths that the words in question have, so a very long word has few.
    at = F.filter(F.array(*[F.lit(k) for k in lengths]), lambda k: k < F.length("word")) if lengths else F.array().cast("array<int>")
    longer = counts.select("seen", F.explode(F.transform(at, lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("stem"))
    return counts, longer.groupBy("stem").agg(F.max("seen").alias("goes_on"))


def _ending_columns(rows: DataFrame) -> DataFrame:
    """stop: a stop ends the text; last: else its last word; sure: it breaks off by its form alone."""
    end, final = F.col("end"), F.right(F.col("end"), F.lit(1))
    stops = ".!?。！？؟"
    stop = (final.isin(*stops) | (final.isin(*"\"')]*_") & end.rlike(rf"[{stops}][\"')\]*_]*$"))) & ~F.endswith(end, F.lit("...")) & (final != "…")
    marker = end.contains("\n") & end.rlike(r"\n\s*(?:\d{1,3}[.)]|[-*•])$")  # a bare number alone is an answer
    brackets = F.length(F.regexp_replace(end, r"[^(\[{]", "")) > F.length(F.regexp_replace(F.regexp_replace(end, r"(?m)^\s*\d{1,3}\)", ""), r"[^)\]}]", ""))
    opened = (end.contains("(") | end.contains("[") | end.contains("{")) & brackets
    quoted = ((F.length(end) - F.length(F.replace(end, F.lit('"'), F.lit("")))) % 2 == 1) & ~F.col("stop")
    comma = final.isin(*",;:([{–—-") & end.rlike(r"[\p{L}\p{N}]\s*[,;:(\[{–—-]$")
    last = F.lower(F.regexp_extract(end, r"(?<![\p{L}\p{M}])([\p{L}\p{M}]++)[^\p{L}\p{M}\p{N}]*+$", 1))
    many = F.size("aw") >= 3
    open_word = _among(F.col("last"), " ".join(OPEN_WORDS.values())) & many
    rows = rows.withColumn("stop", stop).withColumn("last", F.when(F.col("stop"), "").otherwise(last))
    return rows.withColumn("sure", marker | opened | quoted | (comma & many) | open_word)


def truncated(rows: DataFrame) -> DataFrame:
    """gen_id of answers that break off.

    Both rates are smoothed, so few occurrences say little at any size of the table: a word counts as
    broken off if it is rare beside a longer word that begins with it, and as one that can't end a
    sentence if it hardly ever stands before a stop. Where the generation ran out of tokens, an ending
    that is undecided otherwise needs less evidence.
    """
    sure = rows.filter("sure").select("gen_id")
    maybe = rows.filter(~F.col("sure") & ~F.col("stop") & (F.col("n_words") >= LEAST_WORDS) & (F.col("last") != "")).select("gen_id", "last", "ran_out")
    words = maybe.select("last").distinct()
    lengths = sorted(r[0] for r in words.select(F.length("last")).distinct().filter("length(last) >= 2").collect())  # a number per length
    counts, stems = endings(rows, lengths)
    words = words.join(counts, F.col("last") == F.col("word"), "left").join(stems, F.col("last") == F.col("stem"), "left")
    seen, most = F.coalesce("seen", F.lit(0)), F.coalesce("goes_on", F.lit(0))
    words = words.select(
        "last",
        *[(seen + SMOOTH * BROKEN_RATE <= r * most).alias(n) for n, r in (("broken", BROKEN_RATE), ("broken_if", RAN_OUT * BROKEN_RATE))],
        *[(F.coalesce("final", F.lit(0)) + SMOOTH_FINAL < r * seen).alias(n) for n, r in (("never", FINAL_RATE), ("never_if", RAN_OUT * FINAL_RATE))],
    )
    found = maybe.join(words, "last").filter(F.col("broken") | F.col("never") | (F.col("ran_out") & (F.col("broken_if") | F.col("never_if"))))
    return sure.unionByName(found.select("gen_id"))


def defects(answers: DataFrame) -> DataFrame:
    """(gen_id, defect) of every triggered defect, distinct.

    A null answer is empty; a null question is taken as empty, so nothing is a copy of it and no
    language differs from it. Rows without gen_id are left out; a gen_id with several contents gets
    the defects of all. finish_reason alone decides nothing: "length" with a complete text is no defect,
    and what breaks off does so whatever it says; it lowers the evidence that an undecided ending needs.
    Very long answers are read whole.
    """
    rows = _ending_columns(_copy_columns(_refusal_columns(_language_columns(pairs(answers))))).withColumn("empty", is_empty())
    rows = rows.select(
        "gen_id", "q", "a", "last", "stop", "sure", "ran_out", F.size("aw").alias("n_words"), "empty",
        (~F.col("empty") & is_refusal()).alias("refusal"), (~F.col("empty") & is_copy()).alias("copy"), (~F.col("empty") & is_language()).alias("language"),
    )
    rows = cut(rows, "pairs")
    flags = rows.select("gen_id", F.explode(F.array_compact(F.array(*[F.when(F.col(x), F.lit(x)) for x in ORDER[:-1]]))).alias("defect"))
    cut_off = truncated(rows.filter(~F.col("empty"))).select("gen_id", F.lit("truncated").alias("defect"))
    return flags.unionByName(cut_off).distinct()


@LLM.query("p4_defects")
def p4_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every triggered defect of every generation."""
    return defects(table(spark, sf_dir, "answers", "gen_id", "question", "answer", "finish_reason"))


@LLM.query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each defective generation with the first defect in the order of the rules."""
    found = defects(table(spark, sf_dir, "answers", "gen_id", "question", "answer", "finish_reason"))
    rank = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("defect"))
    return found.groupBy("gen_id").agg(F.min_by("defect", rank).alias("defect"))
