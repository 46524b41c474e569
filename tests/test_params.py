import math

import pytest

from echosieve import BandShape, BloomShape, Params
from echosieve.sources.sinks import output_folder


@pytest.mark.parametrize("changes", [
    {"chunk_size": 0}, {"max_chunks": 0}, {"minhash_threshold": 0.0}, {"minhash_threshold": 1.0},
    {"minhash_num_hashes": 0}, {"bloom_error_rate": 1.0, "bloom_capacity": 5},
    {"bloom_error_rate": 0.1, "bloom_capacity": 0}, {"method": "bloomfilter"},
    {"method": "minhash_bloom_hybrid", "bloom_capacity": 10}, {"method": "exact", "key": "url"},
    {"method": "minhash", "key": "url"}, {"config_column": "config"},
])
def test_bounds_are_checked(changes):
    with pytest.raises(ValueError):
        Params(**changes)


def test_exact_and_minhash_need_no_filter_settings():
    assert Params(method="exact").has_bloom is False
    assert Params(method="minhash").minhash_num_hashes == 150


def test_first_coefficients():
    from echosieve.functions.minhash import coefficients

    assert coefficients(2) == [(48271, 182605794), (1291394886, 1914720637)]


@pytest.mark.parametrize("threshold,hashes,bands,rows", [
    (0.8, 150, 11, 13), (0.7, 150, 16, 9), (0.8, 128, 9, 13), (0.5, 150, 27, 5), (0.9, 150, 6, 25),
])
def test_band_shape(threshold, hashes, bands, rows):
    assert BandShape.chosen(threshold, hashes) == BandShape(bands, rows)


def test_match_probability_at_the_threshold():
    assert round(BandShape(11, 13).match_probability(0.8), 2) == 0.46
    assert round(BandShape(16, 9).match_probability(0.7), 2) == 0.48


@pytest.mark.parametrize("n,p,m,k", [
    (10**6, 0.001, 14377587, 9), (300, 0.05, 1870, 4), (1000, 0.01, 9585, 6),
])
def test_bloom_shape_is_truncated(n, p, m, k):
    assert BloomShape.sized(n, p) == BloomShape(m, k)
    assert m <= -n * math.log(p) / math.log(2) ** 2 < m + 1


def test_filter_without_hashes_is_refused():
    with pytest.raises(ValueError, match="hashes"):
        BloomShape.sized(100, 0.9)


def test_output_folder():
    p = Params(dataset_config="en", chunk_size=10_000, max_chunks=10)
    assert output_folder(p) == "deduplicated_en_using_exact_with_100k_data"
    assert output_folder(p.but(max_chunks=None)).endswith("with_all_data")
