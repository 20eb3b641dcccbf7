import hashlib
import zlib

import numpy as np

from ratingscope.llm import jpeg, media

TABLE = jpeg.Huffman(bytes([0] * 8 + [255] + [1] + [0] * 6), bytes(range(256)))  # every symbol, 9 or 10 bits


class Out:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def symbol(self, s):
        n, code = TABLE.code[s]
        self.put(code, n)

    def signed(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def data(self):
        return np.packbits(np.array(self.bits + [1] * (-len(self.bits) % 8), np.uint8)).tobytes()


def plain_encoder(image, high_bits=2):
    """A straightforward progressive encoder after the standard's text, with zero runs and end-of-band runs."""
    seg = jpeg._segment
    out = [b"\xff\xd8"] + [seg(0xDB, bytes([k]) + bytes(q.tolist())) for k, q in image.quant.items()]
    frame = b"".join(bytes([c.ident, c.h << 4 | c.v, c.table]) for c in image.components)
    out.append(seg(0xC2, bytes([8]) + image.height.to_bytes(2, "big") + image.width.to_bytes(2, "big") + bytes([len(image.components)]) + frame))
    out.append(seg(0xC4, b"\x00" + TABLE.lengths + TABLE.symbols + b"\x10" + TABLE.lengths + TABLE.symbols))
    alone = len(image.components) == 1
    orders = [image.order(c, alone) for c in image.components]
    ids = [c.ident for c in image.components]
    o, before = Out(), [0] * len(ids)
    for unit in range(len(orders[0])):
        for k, c in enumerate(image.components):
            for b in orders[k][unit]:
                v = int(c.coef[b, 0]) >> 1
                d = v - before[k]
                before[k] = v
                o.symbol(abs(d).bit_length())
                o.signed(d) if d else None
    out.append(jpeg._as_scan(ids, 0, 0, 0x01, o.data()))
    o = Out()
    for unit in range(len(orders[0])):
        for k, c in enumerate(image.components):
            for b in orders[k][unit]:
                o.put(int(c.coef[b, 0]) & 1, 1)
    out.append(jpeg._as_scan(ids, 0, 0, 0x10, o.data()))
    for c in image.components:
        own = image.order(c, True).ravel()
        for first, last in ((1, 5), (6, 63)):
            for low in range(high_bits, -1, -1):
                o, run, late = Out(), 0, []

                def flush():
                    nonlocal run, late
                    if run:
                        n = run.bit_length() - 1
                        o.symbol(n << 4)
                        o.put(run - (1 << n), n)
                    for x in late:
                        o.put(x, 1)
                    run, late = 0, []

                for b in own:
                    row = [int(x) for x in c.coef[b, first : last + 1]]
                    now = [(abs(x) >> low) * (1 if x >= 0 else -1) for x in row]
                    zeros, fix = 0, []
                    if low == high_bits:
                        new = [k for k, x in enumerate(now) if x]
                        for k, x in enumerate(now):
                            if not new or k > new[-1]:
                                break
                            if x == 0:
                                zeros += 1
                                continue
                            flush()
                            while zeros > 15:
                                o.symbol(0xF0)
                                zeros -= 16
                            o.symbol(zeros << 4 | abs(x).bit_length())
                            o.signed(x)
                            zeros = 0
                        if not new or new[-1] < len(row) - 1:
                            run += 1
                        continue
                    new = [k for k, x in enumerate(now) if abs(x) == 1]
                    end = new[-1] if new else -1
                    for k, x in enumerate(now):
                        if k > end:
                            if abs(x) > 1:
                                fix.append(abs(x) & 1)
                            continue
                        if abs(x) > 1:
                            fix.append(abs(x) & 1)
                        elif x == 0:
                            if zeros == 15:
                                flush()
                                o.symbol(0xF0)
                                [o.put(f, 1) for f in fix]
                                zeros, fix = 0, []
                            else:
                                zeros += 1
                        else:
                            flush()
                            o.symbol(zeros << 4 | 1)
                            o.put(1 if x > 0 else 0, 1)
                            [o.put(f, 1) for f in fix]
                            zeros, fix = 0, []
                    if end < len(row) - 1:
                        run += 1
                        late += fix
                flush()
                bits = low if low == high_bits else (low + 1) << 4 | low
                out.append(jpeg._as_scan([c.ident], first, last, bits, o.data()))
    return b"".join([*out, b"\xff\xd9"])


def random_image(seed, width, height, layout):
    r = np.random.default_rng(seed)
    image = jpeg.Image(width, height, [jpeg.Component(k + 1, h, v, 0) for k, (h, v) in enumerate(layout)], {0: np.full(64, 3, np.int32)})
    image.layout()
    for c in image.components:
        sparse = r.random(c.coef.shape) < 0.15
        c.coef[:] = np.where(sparse, r.integers(-200, 200, c.coef.shape), 0)
        inside = np.zeros(len(c.coef), bool)
        inside[image.order(c, True).ravel()] = True
        c.coef[~inside, 1:] = 0  # scans of one component have only the blocks that the image covers
    return image


def test_any_progressive_file_gives_its_coefficients():
    for seed, (w, h, layout) in enumerate([(40, 24, [(1, 1)]), (37, 51, [(2, 2), (1, 1), (1, 1)]), (64, 16, [(2, 1), (1, 1), (1, 1)])]):
        image = random_image(seed, w, h, layout)
        back = jpeg.read(plain_encoder(image))
        for a, b in zip(image.components, back.components):
            assert (a.coef == b.coef).all()
        assert jpeg.rgb(back).shape == (h, w, 3)


def test_own_files_read_the_same_symbol_by_symbol(monkeypatch):
    payload = bytes(range(256)) * 3
    data = media.pack(payload)
    fast = jpeg.read(data)
    monkeypatch.setattr(jpeg.Huffman, "values", None)
    slow = jpeg.read(data)
    assert all((a.coef == b.coef).all() for a, b in zip(fast.components, slow.components))
    assert media.unpack(slow) == payload


def test_inverse_transform_against_the_definition():
    image = random_image(5, 8, 8, [(1, 1)])
    image.components[0].coef[:] //= 20
    want = np.zeros((8, 8))
    for k, x in enumerate(image.components[0].coef[0] * 3):
        u, v = divmod(int(jpeg.ZIGZAG[k]), 8)
        cu, cv = (np.sqrt(0.5) if z == 0 else 1 for z in (u, v))
        a = np.arange(8)
        want += cu * cv / 4 * x * np.outer(np.cos((2 * a + 1) * u * np.pi / 16), np.cos((2 * a + 1) * v * np.pi / 16))
    assert np.abs(jpeg.rgb(image)[..., 0].astype(int) - np.clip(np.rint(want + 128), 0, 255)).max() <= 1


def test_many_blocks_need_several_runs():
    payload = np.random.default_rng(1).integers(0, 256, 64 * 50_000, dtype=np.uint8).tobytes()
    assert media.unpack(jpeg.read(media.pack(payload))) == payload


def test_documents(spark):
    texts = ["", None, "é" * 1000, "a", "a", "x" * 64, "\x00\xff", "word " * 20_000]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "null id", 1)], "doc_id long, text string, media int")
    rows = {r.doc_id: r for r in media.digests(media.load(media.store(docs))).collect()}
    assert len(rows) == 9 and rows[3][1:] == rows[4][1:]
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.rgb_bytes == r.height * r.width * 3
    assert media.load(media.store(docs.limit(0))).count() == 0
