"""Classes of responses from their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (substrings, label, keep in cache, switch key), the first that a response contains counts.
ERRORS = [
    (["The request to the API has timed out. Please try again later, or if the issue persists"], "API temporarily not working error...", False, False),
    (["Your Client (working) ---> Gateway (working) ---> API (not working)"], "API not working error...", False, False),
    (["Unauthorized", "unauthorized"], "Unauthorized error...", True, False),
    (["You are not subscribed to this API."], "Unsubscribed error...", False, True),
    (["Too many requests"], "Too many requests error...", False, True),
    (["You have exceeded", "you are being rate limited"], "Rate limit error...", False, True),
    (["Access restricted. Check credits balance or enter the correct API key."], "Rate limit error...", False, True),
    (["Oops, an error in the gateway has occurred."], "Gateway error...", False, True),
    (["Blocked User. Please contact your API provider."], "Blocked error...", False, True),
    (["error"], "Message error...", False, False),
]
#: Status codes of labels; all others have 0.
STATUS = [("API not working error...", 6), ("Unauthorized error...", 7), ("Unsubscribed error...", 8), ("Too many requests error...", 9), ("Rate limit per minute error...", 10), ("Rate limit error...", 10), ("Message error...", 11)]
#: What an accepted response never contains, in lower case and as written.
REJECTED = ["rate limit", "time out", "timed out", "does not exist", "404", "504", "500", "internal error", "api doesn't exists", "authoriz", "authenticat", "blocked", "401", "403", "credential", "unsubscribe", "disabled for your subscription", "parameter", "parse", "is not defined"]
REJECTED_AS_WRITTEN = ["Service Not Found", "ACCESS_DENIED", "status_code=50", "status_code=429"]


def _any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for x in parts:
        out = out | F.contains(text, F.lit(x))
    return out


def classify_error(response: Column) -> Column:
    """struct<error, save_cache, switch>; a timed-out response keeps its own label."""
    made = lambda label, save, switch: F.struct(F.lit(label).alias("error"), F.lit(save).alias("save_cache"), F.lit(switch).alias("switch"))
    out = made("", True, False)
    for parts, label, save, switch in reversed(ERRORS):
        out = F.when(_any(response, parts), made(label, save, switch)).otherwise(out)
    return out


def status_code(error: Column) -> Column:
    out = F.lit(0)
    for label, code in STATUS:
        out = F.when(error == label, code).otherwise(out)
    return out


def acceptable(response: Column) -> Column:
    """Whether a response is worth keeping: not empty and free of signs of failure; a refused keyword argument is kept."""
    text = F.coalesce(response, F.lit(""))
    bad = _any(F.lower(text), REJECTED) | _any(text, REJECTED_AS_WRITTEN) | (text == "")
    return F.contains(F.lower(text), F.lit("got an unexpected keyword argument")) | ~bad
