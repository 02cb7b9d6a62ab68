import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lineaudit.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "tests")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


@pytest.fixture
def records(spark):
    """Build evaluation records from (spec, status, whole, energies, labels) tuples."""
    schema = ("impl_id string, spec_id string, source string, status string, whole_impl_energy double, "
              "per_line_energies array<double>, buggy_line_indices array<int>, scorable_line_texts array<string>")

    def make(*rows):
        data = []
        for i, r in enumerate(rows):
            spec, status, whole, energies, labels = r[:5]
            texts = r[5] if len(r) > 5 else [f"line {j}" for j in range(len(energies))]
            data.append((f"i{i}", spec, "s", status, float(whole), [float(e) for e in energies], labels, texts))
        return spark.createDataFrame(data, schema)
    return make
