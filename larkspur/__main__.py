"""`python -m larkspur [data_dir]`: one statement a line, whose plan goes to the error output; quit or exit ends."""

import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from larkspur import Engine
from larkspur.errors import EngineError


def main() -> None:
    engine = Engine(SparkSession.builder.appName("larkspur").getOrCreate(), sys.argv[1] if len(sys.argv) > 1 else "larkspur-data")
    for line in sys.stdin:
        text = line.strip()
        if text.lower() in ("quit", "exit"):
            break
        if not text:
            continue
        try:
            print(engine.plan(text), file=sys.stderr)
            df = engine.sql(text)
            df.show(truncate=False) if df.columns else print("OK")
        except (EngineError, PySparkException) as error:
            print(f"error: {error}", file=sys.stderr)


if __name__ == "__main__":
    main()
