"""Pictures in rounds: as many at a time as disk and driver hold, with the rows of all."""

import os

import pytest

from assetflow.plans import pictures as P
from assetflow.sources import images as I

SF = "/root/testdata/sf0.001"


def standing(folder):
    """Files below the folder of this round's files and below those of the other rounds."""
    top = folder.removeprefix("file://").rpartition("/round-")[0]
    return [os.path.join(d, f) for d, _, names in os.walk(top) for f in names if "/files" in d]


@pytest.mark.parametrize(("query", "reader", "limit"), [("preview_quality", "pixel_range", ("MOST_BYTES", 1 << 21)), ("image_metadata", "scan_images", ("MOST_FILES", 50))])
def test_pictures_stand_in_rounds(spark, monkeypatch, query, reader, limit):
    whole = sorted(getattr(P, query)(spark, SF).collect())
    seen, read = [], getattr(I, reader)

    def counted(session, folder, *more):
        seen.append((folder, len(standing(folder))))
        return read(session, folder, *more)

    monkeypatch.setattr(I, reader, counted)
    monkeypatch.setattr(P, *limit)
    assert sorted(getattr(P, query)(spark, SF).collect()) == whole
    assert len(seen) >= 3 and max(n for _, n in seen) < len(whole) // 2
    assert not any(standing(folder) for folder, _ in seen)
