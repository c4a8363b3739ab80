"""The event log with its subscribers and rules: what is created is appended, sent out, and may alert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.rules import Rule, alerts_from_events
from emberline.streaming.feed import ChangeFeed
from emberline.streaming.run import Subscription


class EventLog:
    """Events and the alerts that rules make of them, each in a feed of its own. Ids are those of the feeds, so several
    programs may create events at once."""

    def __init__(self, events: ChangeFeed, alerts: ChangeFeed, rules: Sequence[Rule] = ()) -> None:
        self.events, self.alerts, self.rules = events, alerts, rules

    def create(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """Append events of rows (ts, properties, labels), which sends them to all subscribers, and the alerts of each
        rule that one of them fires. The alerts, as appended.

        With a batch name the call may be repeated, after a failure between the two too: what is there isn't made again.
        """
        labels = F.coalesce("labels", F.array().cast("array<string>"))
        made = self.events.append(rows.select("ts", "properties", labels.alias("labels")), batch, ("ts", "properties"))
        return self._alert(made, batch)

    def _alert(self, made: DataFrame, batch: str | None) -> DataFrame:
        if not self.rules:
            return self.alerts.rows().limit(0)
        found = alerts_from_events(made, self.rules).withColumns({"acknowledged": F.lit(False), "change": F.lit("created")})
        return self.alerts.append(found, batch, ("ts", "event_id", "place"))

    def watch(self, name: str, period_ms: int = 200) -> Subscription:
        """Evaluate the rules in a stream, over all events that any program creates. The alerts of a batch are committed
        once, under its number: a batch that was cut short is run again and makes no second ones."""
        return self.events.each_batch(lambda batch, number: self._alert(batch, f"{name}:{number}"), only_new=False, period_ms=period_ms, name=name)
