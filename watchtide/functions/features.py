"""The model's input features as column expressions over audit events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stand-ins for an unknown time, office hours, console names, variance scale.
UNKNOWN_HOUR, UNKNOWN_WEEKDAY = 12, 3
OFFICE_FROM, OFFICE_UNTIL = 8, 18
WEEKEND_FROM = 5
CONSOLE_WORDS = ("ConsoleLogin", "SignIn", "Federation", "SwitchRole")
VARIANCE_SCALE = 10000.0


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def hour_of_day(ts: Column) -> Column:
    return F.coalesce(F.hour(ts), F.lit(UNKNOWN_HOUR)) / F.lit(24.0)


def day_of_week(ts: Column) -> Column:
    return F.coalesce(F.weekday(ts), F.lit(UNKNOWN_WEEKDAY)) / F.lit(7.0)


def is_weekend(ts: Column) -> Column:
    return _flag(F.weekday(ts) >= WEEKEND_FROM)


def is_business_hours(ts: Column) -> Column:
    return _flag((F.hour(ts) >= OFFICE_FROM) & (F.hour(ts) < OFFICE_UNTIL))


def identity_type(user_identity: Column) -> Column:
    """Lower-cased `type` of the identity JSON; null when it is no JSON object."""
    return F.lower(F.get_json_object(user_identity, "$.type"))


def is_root_user(identity: Column) -> Column:
    return _flag(identity == "root")


def is_assumed_role(identity: Column) -> Column:
    return _flag(identity == "assumedrole")


def is_error_response(error_code: Column) -> Column:
    return _flag(error_code.isNotNull())


def is_console_action(event_name: Column) -> Column:
    found = F.lit(False)
    for word in CONSOLE_WORDS:
        found = found | event_name.contains(word)
    return _flag(found)


def rarity(count: Column, top_count: Column) -> Column:
    """0 for the commonest category, towards 1 for rare ones, 1 for null or unseen."""
    return F.coalesce(F.lit(1.0) - count / top_count, F.lit(1.0))


def octets(ip: Column) -> Column:
    """The whole numbers between the dots of an address; null where a part is none."""
    return F.split(ip, r"\.").try_cast("array<bigint>")


def ip_octet_variance(numbers: Column) -> Column:
    """Population variance of the four octets, scaled; 0 when there are not four whole numbers."""
    parts = [F.get(numbers, F.lit(i)).cast("double") for i in range(4)]
    mean = (parts[0] + parts[1] + parts[2] + parts[3]) / 4.0
    a, b, c, d = [(p - mean) * (p - mean) for p in parts]
    return F.when(F.size(numbers) == 4, F.coalesce((a + b + c + d) / 4.0 / VARIANCE_SCALE, F.lit(0.0))).otherwise(0.0)
