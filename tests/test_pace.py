"""Calls of a whole job keep their distance, however many tasks make them."""

from redline.operators.generators import ModelGenerator


def test_calls_of_eight_tasks_are_paced_together(spark, tmp_path):
    marks = str(tmp_path)

    def make_client():
        def client(system, turns):
            import time
            import uuid

            with open(f"{marks}/{uuid.uuid4().hex}", "w") as f:
                f.write(repr(time.time()))
            return '{"findings_edits": {}, "impression": null}'

        return client

    def prompts(cases):
        return cases.selectExpr("case_id", "'be brief' AS system", "array(named_struct('role', 'user', 'text', 'x')) AS turns")

    cases = spark.range(40).selectExpr("cast(id AS string) AS case_id", "'FINDINGS:\\nIMPRESSION:' AS template_content").repartition(8)
    delay = 0.1
    out = ModelGenerator(make_client, prompts, delay_seconds=delay, lanes=8).generate(cases, 1).collect()
    assert len(out) == 40
    times = sorted(float(p.read_text()) for p in tmp_path.iterdir())
    assert len(times) == 40
    # lanes drift against each other by less than one round of all lanes
    assert times[-1] - times[0] >= (len(times) - 1 - 8) * delay
    for a, b in zip(times, times[16:]):
        assert b - a >= 8 * delay - 0.05
