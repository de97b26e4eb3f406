import hashlib

import pytest

from signalframe.sources import listings


def test_fingerprint_follows_names_and_contents(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"part{k}.jsonl").write_bytes(bytes([k]) * (k + 1))
    files = listings.digests(spark, [str(tmp_path)], "*.jsonl")
    assert {r.name: (r.bytes, r.digest) for r in files.collect()} == {f"part{k}.jsonl": (k + 1, hashlib.sha256(bytes([k]) * (k + 1)).hexdigest()) for k in range(5)}
    first = listings.fingerprint(files).first()
    assert (first.files, first.bytes, len(first.fingerprint)) == (5, 15, 16)
    assert listings.fingerprint(files.repartition(3)).first() == first
    (tmp_path / "part3.jsonl").write_bytes(b"\x03\x03\x03\x04")
    other = listings.fingerprint(listings.digests(spark, [str(tmp_path)], "*.jsonl")).first()
    (tmp_path / "part3.jsonl").rename(tmp_path / "part9.jsonl")
    third = listings.fingerprint(listings.digests(spark, [str(tmp_path)], "*.jsonl")).first()
    assert len({first.fingerprint, other.fingerprint, third.fingerprint}) == 3
    assert listings.fingerprint(files.limit(0)).first().files == 0


def test_clips_beside_their_labels(spark, tmp_path):
    for n in ("a1.npy", "b2.npy", "c3.npy", "note.txt"):
        (tmp_path / n).write_bytes(b"x")
    labels = spark.createDataFrame([(" a1.avi", 3), ("b2", 0), ("zz.avi", 1)], "ClipID string, Engagement int")
    assert sorted((r.clip, r.label) for r in listings.labelled_clips(spark, str(tmp_path), labels, "Engagement").collect()) == [("a1", 3), ("b2", 0)]
    assert sorted((r.clip, r.label) for r in listings.labelled_clips(spark, str(tmp_path), labels, "Engagement", low=[0, 1]).collect()) == [("a1", 0), ("b2", 1)]
    with pytest.raises(ValueError, match="no rows"):
        listings.labelled_clips(spark, str(tmp_path), labels.filter("Engagement > 5"), "Engagement")
