import numpy as np

from postmill.llm import media


def test_every_sample_lies_in_a_frame():
    rng = np.random.default_rng(1)
    for n in (1, 255, 256, 257, 448, 449, 576, 1152, 5760):
        assert len(media.spectral_peaks(rng.integers(0, 256, n).astype(np.uint8))[0]) == 1 + max(0, -(-(n - media.FRAME) // media.HOP))
    assert len(media.spectral_peaks(np.zeros(0, np.uint8))[0]) == 0


def test_other_ends_give_other_features():
    rng = np.random.default_rng(2)
    one = rng.integers(0, 256, 5760).astype(np.uint8)
    two = one.copy()
    two[-128:] = rng.integers(0, 256, 128)
    features = [media.fingerprint(media.to_wav(x.tobytes())) for x in (one, two)]
    assert features[0][2].tolist() != features[1][2].tolist()
