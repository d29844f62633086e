"""Users: profiles, registration and profile updates from command tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import exprs as X
from quire.operators.cart import CONFLICT, INVALID, NOT_FOUND, OK, command_faults
from quire.operators.skew import written

COLUMNS = ("id", "name", "email", "created_at", "updated_at")
MIN_NAME_LENGTH = 3  # fixed value


class UserChange(NamedTuple):
    """Users after the commands, and one result row per command."""

    users: DataFrame
    results: DataFrame


def profiles(users: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Public profile fields, of all users or of those asked for (user_id)."""
    if asked is not None:
        ids = asked.select(F.col("user_id").alias("id")).distinct()
        users = users.join(ids, "id", "left_semi")
    return users.select("id", "name", "email", "created_at")


def _flag(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("cmd_id", F.lit(True).alias(name))


def registration_faults() -> Column:
    """Rules a sign-up form and the registration itself apply."""
    name, email = F.col("name"), F.col("email")
    given = F.coalesce(email, F.lit("")) != ""
    return command_faults(
        {
            "email_required": ~given,
            "name_required": X.text_or_null("name").isNull(),
            "name_too_short": F.coalesce(F.length(name), F.lit(0)) < MIN_NAME_LENGTH,
            "email_format": given & ~email.rlike(X.EMAIL_PATTERN),
        }
    )


def update_faults() -> Column:
    name, email = F.col("name"), F.col("email")
    return command_faults(
        {
            "name_blank": name.isNotNull() & X.text_or_null("name").isNull(),
            "email_blank": email.isNotNull() & X.text_or_null("email").isNull(),
            "no_fields": name.isNull() & email.isNull(),
        }
    )


def register(users: DataFrame, commands: DataFrame) -> UserChange:
    """Register commands; an e-mail belongs to the stored user or the earliest command.

    E-mails are compared as given, names are stored trimmed.
    """
    bad = (F.coalesce("email", F.lit("")) == "") | X.text_or_null("name").isNull()
    valid = commands.filter(~bad)
    earliest = valid.groupBy("email").agg(F.min_by("cmd_id", F.struct("ts", "cmd_id")).alias("cmd_id"))
    winners = earliest.join(users.select("email"), "email", "left_anti")
    results = (
        commands.join(_flag(winners, "_won"), "cmd_id", "left")
        .withColumn("status", F.when(bad, INVALID).when(F.col("_won"), OK).otherwise(CONFLICT))
        .drop("_won")
    )
    added = results.filter(F.col("status") == OK).select(
        X.derived_id("cmd_id").alias("id"),
        X.js_trim("name").alias("name"),
        "email",
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )
    return UserChange(users.select(*COLUMNS).unionByName(added), results.select("cmd_id", "email", "status"))


def email_conflicts(users: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands asking for an e-mail that another user holds."""
    asked = commands.withColumn("_email", X.text_or_null("email"))
    holders = users.select(F.col("email").alias("_email"), F.col("id").alias("_holder"))
    return (
        asked.join(holders, "_email")
        .filter(F.col("_holder") != F.col("user_id"))
        .select("cmd_id", "user_id", F.col("_email").alias("email"), F.col("_holder").alias("held_by"))
    )


def update_profiles(users: DataFrame, commands: DataFrame) -> UserChange:
    """Partial updates of name and e-mail.

    E-mails are checked against the users as they were before the batch and against
    earlier commands in it: the earliest claim of an e-mail wins.
    """
    parsed = commands.withColumns(
        {"_bad": F.size(update_faults()) > 0, "_name": X.text_or_null("name"), "_email": X.text_or_null("email")}
    )
    clash = email_conflicts(users, parsed.filter(~F.col("_bad"))).select("cmd_id").distinct()
    ids = users.select(F.col("id").alias("user_id"), F.lit(True).alias("_user"))
    checked = written(
        parsed.join(_flag(clash, "_taken"), "cmd_id", "left")
        .join(ids, "user_id", "left")
        .select("cmd_id", "user_id", "ts", "_bad", "_name", "_email", "_taken", "_user")
    )
    known = checked.filter(~F.col("_bad") & F.col("_taken").isNull() & F.col("_user"))
    first = (
        known.filter(F.col("_email").isNotNull())
        .groupBy("_email")
        .agg(F.min_by("user_id", F.struct("ts", "cmd_id")).alias("_first"))
    )
    late = known.join(written(first), "_email").filter(F.col("_first") != F.col("user_id"))
    late = written(late.select("cmd_id"))
    ok = known.join(late, "cmd_id", "left_anti")
    at = F.struct("ts", "cmd_id")
    last = ok.groupBy(F.col("user_id").alias("id")).agg(
        F.max_by("_name", F.when(F.col("_name").isNotNull(), at)).alias("_name"),
        F.max_by("_email", F.when(F.col("_email").isNotNull(), at)).alias("_email"),
        F.max("ts").alias("_ts"),
    )
    changed = (
        users.join(last, "id", "left")
        .withColumns(
            {
                "name": F.coalesce("_name", "name"),
                "email": F.coalesce("_email", "email"),
                "updated_at": F.coalesce("_ts", "updated_at"),
            }
        )
        .select(*COLUMNS)
    )
    status = (
        F.when(F.col("_bad"), INVALID)
        .when(F.col("_taken") | F.col("_late"), CONFLICT)
        .when(F.col("_user"), OK)
        .otherwise(NOT_FOUND)
    )
    results = (
        checked.join(_flag(late, "_late"), "cmd_id", "left")
        .withColumn("status", status)
        .select("cmd_id", "user_id", "status", F.when(F.col("status") == OK, 1).otherwise(0).alias("affected_rows"))
    )
    return UserChange(changed, results)
