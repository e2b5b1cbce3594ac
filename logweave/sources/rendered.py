"""Log lines rendered from an events table, and questions rendered from conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.session import lookup_join, spread


def _event_content() -> Column:
    """What a line says of an event: four kinds."""
    n, user_id = F.col("event_id"), F.col("user_id")
    user = user_id.cast("string")
    octet = (n % 256).cast("string")
    return (
        F.when(
            n % 4 == 0,
            F.concat(
                F.lit("user "), user, F.lit(" did "), F.col("event_type"),
                F.lit(" value "), F.format_string("%.2f", F.col("value")),
            ),
        )
        .when(
            n % 4 == 1,
            F.concat(
                F.lit("request from 10.0."), (user_id % 256).cast("string"), F.lit("."), octet,
                F.lit(" took "), (n % 500).cast("string"), F.lit(" ms"),
            ),
        )
        .when(n % 4 == 2, F.concat(F.lit("props "), F.col("props"), F.lit(" accepted")))
        .otherwise(F.concat(F.lit("session closed for user "), user))
    )


def event_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(log_id, line_no, line)``: one application log line per event.

    Lines have the shape ``<Date> <Time> <Level> <Component>: <Content>`` with four kinds of
    content; every 97th line lacks the colon.
    """
    events = spread(spark.read.parquet(f"{folder}/events.parquet"))
    n, content = F.col("event_id"), _event_content()
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.when(F.col("event_type") == "error", F.lit(" ERROR ")).otherwise(F.lit(" INFO ")),
        F.lit("app."),
        F.col("event_type"),
        F.when(n % 97 == 0, F.lit(" ")).otherwise(F.lit(": ")),
        content,
    )
    return events.select(F.lit("events.log").alias("log_id"), (n + 1).alias("line_no"), line.alias("line"))


def layout_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(log_id, line_no, line)``: sixteen logs, one in each of the known layouts, with an equal share of the events.

    Process ids that a layout may leave out are left out of every third line.
    """
    events = spread(spark.read.parquet(f"{folder}/events.parquet"))
    n, user = F.col("event_id"), F.col("user_id").cast("string")
    at = lambda pattern: F.date_format("ts", pattern)
    failed = F.col("event_type") == "error"
    level = F.when(failed, "ERROR").otherwise("INFO")
    component = F.concat(F.lit("app."), F.col("event_type"))
    pid, some_pid = user, F.when(n % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("["), user, F.lit("]")))
    seconds = F.unix_timestamp("ts").cast("string")
    short = lambda yes, no: F.when(failed, yes).otherwise(no)
    layouts: dict[str, list[Column | str]] = {
        "HDFS": [at("yyMMdd HHmmss "), pid, " ", level, " ", component, ": "],
        "Hadoop": [at("yyyy-MM-dd HH:mm:ss,SSS "), level, " [main] org.", component, ": "],
        "Spark": [at("yy/MM/dd HH:mm:ss "), level, " ", component, ": "],
        "Zookeeper": [at("yyyy-MM-dd HH:mm:ss,SSS - "), level, "  [QuorumPeer:", component, "@", pid, "] - "],
        "BGL": ["- ", seconds, at(" yyyy.MM.dd "), "R02-M1 ", at("yyyy-MM-dd-HH.mm.ss.SSSSSS "), "R02-M1 RAS KERNEL ", level, " "],
        "HPC": [n.cast("string"), " node-", pid, " unix.hw state_change ", seconds, " 1 "],
        "Thunderbird": ["- ", seconds, at(" yyyy.MM.dd "), "dn228 ", at("MMM d HH:mm:ss "), "dn228/dn228 crond", some_pid, ": "],
        "Windows": [at("yyyy-MM-dd HH:mm:ss, "), short("Error", "Info"), "                  CBS    "],
        "Linux": [at("MMM d HH:mm:ss "), "combo ", "daemon", some_pid, ": "],
        "Android": [at("MM-dd HH:mm:ss.SSS  "), pid, "  ", pid, " ", short("E", "I"), " Window: "],
        "HealthApp": [at("yyyyMMdd-HH:mm:ss:SSS"), "|Step_", F.col("event_type"), "|", pid, "|"],
        "Apache": [at("'['E MMM dd HH:mm:ss yyyy'] '"), "[", short("error", "notice"), "] "],
        "Proxifier": [at("'['MM.dd HH:mm:ss'] '"), "chrome.exe - "],
        "OpenSSH": [at("MMM d HH:mm:ss "), "LabSZ sshd[", pid, "]: "],
        "OpenStack": ["nova-api.log ", at("yyyy-MM-dd HH:mm:ss.SSS "), pid, " ", level, " nova.", component, " [req-", pid, "] "],
        "Mac": [at("MMM  d HH:mm:ss "), "calvisitor ", "kernel[", pid, "]: "],
    }
    name, line = F.lit(None), F.lit(None)
    for place, (layout, parts) in enumerate(layouts.items()):
        own = n % len(layouts) == place
        head = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        name, line = F.when(own, layout).otherwise(name), F.when(own, head).otherwise(line)
    return events.select(
        F.concat(name, F.lit(".log")).alias("log_id"),
        (F.floor(n / len(layouts)) + 1).alias("line_no"),
        F.concat(line, _event_content()).alias("line"),
    )


def log_questions(spark: SparkSession, folder: str) -> DataFrame:
    """``(question_id, question)``: one question per user turn of the conversations.

    Nine kinds of question about the rendered log, each followed by the user's own words; the
    tenth kind is these words alone.
    """
    turns = spark.read.parquet(f"{folder}/conversations.parquet").filter(F.col("role") == "user")
    conv, turn = F.col("conv_id"), F.col("turn")

    def two_digits(value: Column) -> Column:
        return F.lpad(value.cast("string"), 2, "0")

    def number(value: Column) -> Column:
        return value.cast("string")

    clock = F.concat_ws(":", two_digits(conv % 24), two_digits(turn * 7 % 60), two_digits((conv + turn) % 60))
    kind_name = F.element_at(
        F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), (conv % 5 + 1).cast("int")
    )
    questions = (
        F.lit("Summarize the log."),
        F.concat(F.lit("What happened at "), clock, F.lit("?")),
        F.concat(F.lit("How many times does 'app."), kind_name, F.lit("' occur in the log file?")),
        F.concat(F.lit("What is the event Event"), number(conv % 12 + 1), F.lit("?")),
        F.lit("What kind of log file is this?"),
        F.lit("Are there any abnormal activities?"),
        F.lit("What is a Brute Force Attack?"),
        F.concat(
            F.lit("Which users are named in the event "), number(conv % 9 + 1),
            F.lit(" and in Event"), number(turn % 9 + 1), F.lit("?"),
        ),
        F.concat(F.lit("What are 'user "), number(conv % 150), F.lit("' and 'ERROR' in this log?")),
    )
    question = F.lit("")
    for kind, text in enumerate(questions):
        question = F.when((conv * 7 + turn) % 10 == kind, text).otherwise(question)
    return turns.select((conv * 1000 + turn).alias("question_id"), F.concat_ws(" ", question, "text").alias("question"))


def event_answers(spark: SparkSession, folder: str) -> DataFrame:
    """``(conv_id, turn, text)``: assistant turns that end by naming events of the log."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet").filter(F.col("role") == "assistant")
    first = F.concat(F.lit("Event"), (F.col("conv_id") % 9 + 1).cast("string"))
    second = F.concat(F.lit("Event"), (F.col("turn") % 9 + 1).cast("string"))
    text = F.concat(
        "text", F.lit(" See "), first, F.lit(" and "), second, F.lit(", again "), first, F.lit("; not myEvent3.")
    )
    return turns.select("conv_id", "turn", text.alias("text"))


def document_answers(spark: SparkSession, folder: str, categories: tuple[str, ...]) -> DataFrame:
    """Wide answer table over documents: expected text and four models' answers.

    ``labelled`` is missing for documents without a good quality label, and sheet ``---es``
    is marked as in progress.
    """
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", F.col("text").alias("item"))
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    category = F.element_at(F.array(*map(F.lit, categories)), (F.col("doc_id") % len(categories) + 1).cast("int"))
    return (
        lookup_join(documents.withColumn("item_id", F.col("doc_id") % items.count()), items, ["item_id"])
        .join(labels, "doc_id", "left")
        .select(
            F.when(F.col("lang") == "es", F.lit("---es")).otherwise(F.col("lang")).alias("sheet"),
            F.col("doc_id").alias("question_id"),
            category.alias("category"),
            F.col("text").alias("expected"),
            F.col("text").alias("copy"),
            F.col("item").alias("bench"),
            F.concat_ws(" ", "item", "text").alias("joined"),
            F.when(F.col("quality") == 1, F.col("text")).alias("labelled"),
        )
    )


def document_metrics(
    spark: SparkSession, folder: str, categories: tuple[str, ...], metrics: tuple[str, str]
) -> DataFrame:
    """Metric values ``(sheet, category, model, metric, value)``: two per document."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    doc, chars = F.col("doc_id"), F.col("n_chars")
    category = F.element_at(F.array(*map(F.lit, categories)), (doc % len(categories) + 1).cast("int"))
    values = F.array(
        F.struct(F.lit(metrics[0]).alias("metric"), ((chars * 31 + doc * 17) % 1000 / 1000).alias("value")),
        F.struct(F.lit(metrics[1]).alias("metric"), ((chars * 13 + doc * 7) % 1000 / 1000).alias("value")),
    )
    model = F.concat(F.lit("model-"), (doc % 5).cast("string"))
    return documents.select(
        F.col("lang").alias("sheet"), category.alias("category"), model.alias("model"), F.explode(values).alias("_v")
    ).select("sheet", "category", "model", "_v.metric", "_v.value")
