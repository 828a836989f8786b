"""Sessions and order joins in streaming state: what closes, what is late, what waits, and how much is kept."""

from conftest import rows, ts

from shopspark.streaming.ingest import append_to
from shopspark.streaming.joins import items_with_heads
from shopspark.streaming.sessions import closed_sessions, fold_locally, late_clicks

CLICKS = "event_id bigint, user_id bigint, ts timestamp, event_type string"


class Feed:
    """A folder that a stream reads; every ``run`` is a new query that goes on from the checkpoint."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.count = spark, str(path), schema, 0

    def give(self, given):
        self.spark.createDataFrame(given, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        return self.stream()

    def stream(self):
        schema = self.spark.createDataFrame([], self.schema).schema
        return self.spark.readStream.schema(schema).parquet(f"{self.path}/in")

    def run(self, stream, name="out"):
        progress = append_to(stream, f"{self.path}/{name}", f"{self.path}/{name}-checkpoint")
        return progress, self.spark.read.schema(stream.schema).parquet(f"{self.path}/{name}")


def click(number, user, at, kind="view"):
    return (number, user, ts(at) if at else None, kind)


def test_sessions_close_with_the_watermark(spark, tmp_path):
    fold_locally(spark)
    feed = Feed(spark, tmp_path, CLICKS)
    first = [click(1, 7, "2024-01-01T00:00:00"), click(2, 7, "2024-01-01T11:59:59", "click"), click(3, 8, "2024-01-01T05:00:00"),
             click(4, None, "2024-01-01T05:00:00"), click(5, 7, None)]
    progress, out = feed.run(closed_sessions(feed.give(first)))
    assert out.count() == 0 and progress[-1].stateOperators[0].numRowsTotal == 2
    # The third day closes both; a gap of exactly twelve hours starts a new session.
    progress, out = feed.run(closed_sessions(feed.give([click(6, 9, "2024-01-04T00:00:00"), click(7, 9, "2024-01-04T12:00:00", "purchase")])))
    found = {(r.user_id, str(r.started_at), str(r.last_at), r.clicks, r.has_cart) for r in out.collect()}
    assert found == {(7, "2024-01-01 00:00:00", "2024-01-01 11:59:59", 2, 1), (8, "2024-01-01 05:00:00", "2024-01-01 05:00:00", 1, 0)}
    assert progress[-1].stateOperators[0].numRowsTotal == 2  # the state follows the watermark, not the clicks
    progress, out = feed.run(closed_sessions(feed.give([click(8, 9, "2024-02-01T00:00:00")])))
    assert out.where("user_id = 9").count() == 2 and progress[-1].stateOperators[0].numRowsTotal == 1


def test_clicks_within_the_bound_join_late_ones_go_apart(spark, tmp_path):
    feed = Feed(spark, tmp_path, CLICKS)
    stream = feed.give([click(1, 7, "2024-01-10T00:00:00"), click(2, 8, "2024-01-12T00:00:00")])
    feed.run(closed_sessions(stream))
    feed.run(late_clicks(stream), "late")
    stream = feed.give([click(3, 7, "2024-01-10T06:00:00"), click(4, 7, "2024-01-09T11:00:00"), click(5, 7, "2024-01-02T00:00:00"),
                        click(6, 8, "2024-03-01T00:00:00")])
    _, out = feed.run(closed_sessions(stream))
    _, late = feed.run(late_clicks(stream), "late")
    assert rows(late.select("event_id")) == [(4,), (5,)]
    assert {str(w.watermark) for w in late.collect()} == {"2024-01-10 00:00:00"}
    assert out.where("user_id = 7").select("clicks").collect()[0][0] == 2


def test_a_hot_user_is_folded_in_the_tasks(spark, tmp_path):
    fold_locally(spark)
    feed = Feed(spark, tmp_path, CLICKS)
    many = [click(i, 1, f"2024-01-01T{i % 10:02d}:{i % 60:02d}:00") for i in range(3000)]
    feed.run(closed_sessions(feed.give(many)))
    progress, out = feed.run(closed_sessions(feed.give([click(9999, 2, "2024-02-01T00:00:00")])))
    assert [(r.user_id, r.clicks) for r in out.collect()] == [(1, 3000)]


ITEMS = "id bigint, order_id bigint, placed_at timestamp"
HEADS = "order_id bigint, user_id bigint, status string, created_at timestamp"


def test_items_meet_heads_or_go_out_with_a_reason(spark, tmp_path):
    items, heads = Feed(spark, tmp_path / "items", ITEMS), Feed(spark, tmp_path / "heads", HEADS)
    join = lambda: items_with_heads(items.stream(), heads.stream())
    items.give([(1, 10, ts("2024-01-01T05:00:00")), (2, 11, ts("2024-01-01T05:00:00")), (3, None, ts("2024-01-01T05:00:00"))])
    heads.give([(10, 70, "Complete", ts("2024-01-01T00:00:00")), (12, 72, "Shipped", ts("2024-01-01T00:00:00"))])
    _, out = items.run(join())
    assert rows(out.select("id", "user_id", "reason")) == [(1, 70, None)]  # the others still wait
    # An item that comes a run later finds the head in the state; one beyond the bound of two days does not.
    items.give([(4, 12, ts("2024-01-02T20:00:00")), (5, 10, ts("2024-01-03T06:00:00"))])
    heads.give([(13, 73, "Complete", ts("2024-01-03T00:00:00"))])
    items.run(join())
    items.give([(6, 99, ts("2024-02-01T00:00:00"))])
    heads.give([(98, 1, "Complete", ts("2024-02-01T00:00:00"))])
    progress, out = items.run(join())
    found = {r.id: (r.user_id, r.reason) for r in out.collect()}
    assert found == {1: (70, None), 4: (72, None), 2: (None, "missing order"), 3: (None, "missing order"), 5: (None, "missing order")}
    assert progress[-1].stateOperators[0].numRowsTotal <= 2  # what the watermark has passed is gone
