"""Pages are parsed a few at a time."""

import pyarrow as pa

from lexdrift.sources import pages


def test_a_batch_of_pages_gives_many_small_ones():
    page = "<html><body><a name='MO'></a><p>1. One</p><p>2. Two</p></body></html>"
    n = pages.PAGES * 3 + 1
    batch = pa.record_batch({"celex": pa.array(range(n)), "__name": pa.array([str(k) for k in range(n)]), "__html": pa.array([page] * (n - 2) + [None, "<p>none</p>"])})
    out = list(pages.parsed_batches(iter([batch])))
    assert len(out) == 4 and max(b.num_rows for b in out) == 2 * pages.PAGES
    rows = pa.Table.from_batches(out).to_pylist()
    assert len(rows) == 2 * (n - 2)
    assert rows[-1] == {"celex": n - 3, "para_idx": 1, "para_id": f"{n - 3}_P0002", "para_num": "2", "section": "grounds", "text": "Two"}
