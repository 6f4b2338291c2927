import pytest

from colloquy.operators import check_reply, enrich_with_retry, observe_batch
from colloquy.operators.enrich import call_with_retry
from colloquy.plans import outcomes


@pytest.mark.parametrize(
    "failures, attempts, waited", [(0, 1, 0), (1, 2, 10), (2, 3, 30), (3, 3, 30)]
)
def test_retry_table(failures, attempts, waited):
    calls, waits = [], []

    def fn(text):
        calls.append(text)
        if len(calls) <= failures:
            raise RuntimeError(f"down {len(calls)}")
        return '{"title":"ok"}'

    n, reply, error = call_with_retry(fn, "text", check_reply, 3, 10, waits.append)
    assert (n, len(calls), sum(waits)) == (attempts, attempts, waited)
    assert (reply is None) == (failures == 3)
    assert error == ("down 3" if failures == 3 else None)


@pytest.mark.parametrize(
    "reply, attempts",
    [
        ("no braces", 1),
        ('{"title":"t"}', 1),
        ('{"title":', 1),
        ('{"title":}', 3),
        ('{"title":null}', 3),
        ('{"date":5}', 3),
    ],
)
def test_what_is_worth_a_retry(reply, attempts):
    n, _, _ = call_with_retry(lambda t: reply, "text", check_reply, 3, 0, lambda s: None)
    assert n == attempts


def test_replies_and_outcomes(spark):
    def reply_by_text(text):
        if text == "down":
            raise OSError("no route")
        if text == "chatty":
            return "I would rather not."
        return '{"title":"' + text + '","date":"2024-03-01"}'

    rows = [("1", "a", "u"), ("2", "", "u"), ("3", None, "u"), ("4", "down", "u"), ("5", "chatty", "u")]
    df = spark.createDataFrame(rows, "file_id string, text string, user_folder_id string")
    called = enrich_with_retry(
        df, reply_by_text, backoff=0, partitions=3, keep=("user_folder_id",)
    )
    assert called.rdd.getNumPartitions() == 3
    seen, observation = observe_batch(outcomes(called), "test")
    done = {r.file_id: r for r in seen.collect()}
    assert {k: r.attempts for k, r in done.items()} == {"1": 1, "2": 0, "3": 0, "4": 3, "5": 1}
    assert done["1"].output_filename == "2024_03_01_a.json" and done["1"].error == ""
    empty = "Transcript download failed: Transcript download failed"
    assert done["2"].error == done["3"].error == empty
    no_summary = "Summary generation failed (see logs for detail)"
    assert done["4"].error == done["5"].error == no_summary
    assert done["4"].call_error == "no route" and done["5"].reply == "I would rather not."
    assert observation.get == {"rows": 5, "succeeded": 1, "failed": 4}
