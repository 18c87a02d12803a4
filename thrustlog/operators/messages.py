"""Packets to commands: acknowledgements, text messages, filters, envelopes."""

from pyspark.sql import functions as F

from thrustlog.constants import COMMANDS
from thrustlog.plans.lookup import lookup_join

MESSAGE = "remoteid variant, command string, args variant, _bad string"


def acknowledgements(packets):
    """Ids that packets acknowledge. A packet may carry a text message as well."""
    return packets.where(F.col("priority") == "ACK").select(
        F.col("decoded.requestId").alias("request_id"), "ts"
    )


def text_messages(packets):
    return packets.where(F.col("decoded.text").isNotNull()).select(
        "id", "ts", F.col("decoded.text").alias("text")
    )


def parse_messages(messages):
    """JSON objects with their address, command and arguments; other text is dropped.

    ``remoteid`` is what equals an integer id in the stands' own comparison: whole numbers (5 and
    5.0), true and false as 1 and 0, but no quoted number. An address of JSON null stays as a null
    ``remoteid``; a message without the field is dropped. Arguments stay JSON text.
    """
    document = F.from_json(
        F.col("text"), MESSAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    opened = messages.withColumn("_doc", document).select(
        "id",
        "ts",
        F.col("_doc.remoteid").alias("_address"),
        F.schema_of_variant("_doc.remoteid").alias("_kind"),
        F.col("_doc.command").alias("command"),
        F.to_json("_doc.args").alias("args"),
    )
    kind = F.col("_kind")
    number = F.try_variant_get("_address", "$", "double")
    remoteid = (
        F.when(kind == "BIGINT", F.try_variant_get("_address", "$", "bigint"))
        .when(
            (kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"))
            & (number == F.rint(number)),
            number.cast("bigint"),
        )
        .when(kind == "BOOLEAN", F.try_variant_get("_address", "$", "boolean").cast("bigint"))
    )
    # Text that is no JSON object, or has no address, leaves the kind null.
    return (
        opened.where(kind.isNotNull())
        .withColumn("remoteid", remoteid)
        .where(F.col("remoteid").isNotNull() | (kind == "VOID"))
        .select("id", "ts", "remoteid", "command", "args")
    )


def addressed_to(commands, own):
    """Messages for ``own``; an unset own id matches those with a null address."""
    return commands.where(F.col("remoteid").eqNullSafe(F.lit(own).cast("bigint")))


def known_commands(commands, names=COMMANDS):
    return commands.where(F.col("command").isin(list(names)))


def listed_commands(commands, command_table):
    """``known_commands`` for a table of command names."""
    return lookup_join(commands, command_table.select("command").distinct(), ["command"], "drop").select(
        *commands.columns
    )


def handler_arguments(commands):
    return commands.select(
        F.col("id").alias("message_id"), F.col("command").alias("message_command"), "args"
    )


def command_envelope(remoteid, command, args=None):
    """JSON text of a command; empty arguments are left out, a null address is kept."""
    bare = F.to_json(
        F.struct(remoteid.alias("remoteid"), command.alias("command")),
        {"ignoreNullFields": "false"},
    )
    if args is None:
        return bare
    full = F.to_json(
        F.struct(remoteid.alias("remoteid"), command.alias("command"), args.alias("args")),
        {"ignoreNullFields": "false"},
    )
    return F.when(args.isNull() | (args.cast("string") == ""), bare).otherwise(full)
