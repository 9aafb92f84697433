"""The signature catalogue: header and footer patterns of file formats, with the largest size of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KB, MB, GB = 1 << 10, 1 << 20, 1 << 30

#: Extension, category, headers, footers (hexadecimal), largest size in MB.
SIGNATURES = (
    ("jpg", "image", "ffd8ffe0 ffd8ffe1 ffd8ffe8 ffd8ffdb ffd8ffee", "ffd9", 50),
    ("png", "image", "89504e470d0a1a0a", "49454e44ae426082", 50),
    ("gif", "image", "474946383761 474946383961", "003b", 30),
    ("bmp", "image", "424d", "", 50),
    ("tiff", "image", "49492a00 4d4d002a", "", 200),
    ("riff", "other", "52494646", "", 4096),
    ("ico", "image", "00000100", "", 5),
    ("psd", "image", "38425053", "", 500),
    ("svg", "image", "3c737667", "", 10),
    ("pdf", "document", "25504446", "2525454f46", 500),
    ("ole2", "document", "d0cf11e0a1b11ae1", "", 200),
    ("rtf", "document", "7b5c727466", "7d", 100),
    ("mp4", "video", "0000001466747970 0000001866747970 0000001c66747970 0000002066747970", "", 4096),
    (
        "heic", "image",
        "000000186674797068656963 000000186674797068656978 00000018667479706d696631 00000018667479706d736631 000000206674797068656963 "
        "000000206674797068656978 00000020667479706d696631 000000186674797068657663 000000186674797068657678", "", 256,
    ),
    ("avif", "image", "00000020667479706176696600000000 000000186674797061766966 0000001c667479706176696600000000", "", 256),
    ("mkv", "video", "1a45dfa3", "", 4096),
    ("flv", "video", "464c5601", "", 4096),
    ("wmv", "video", "3026b2758e66cf11", "", 4096),
    ("mp3", "audio", "fffb fff3 fff2 494433", "", 100),
    ("flac", "audio", "664c6143", "", 500),
    ("ogg", "audio", "4f676753", "", 200),
    ("aac", "audio", "fff1 fff9", "", 100),
    ("zip", "archive", "504b0304", "504b0506", 2048),
    ("rar", "archive", "526172211a0700 526172211a070100", "", 2048),
    ("7z", "archive", "377abcaf271c", "", 2048),
    ("gz", "archive", "1f8b", "", 2048),
    ("bz2", "archive", "425a68", "", 1024),
    ("sqlite", "database", "53514c69746520666f726d6174203300", "", 2048),
    ("exe", "other", "4d5a", "", 500),
    ("elf", "other", "7f454c46", "", 500),
    ("djvu", "document", "41542654464f524d", "", 500),
    ("mid", "audio", "4d546864", "", 10),
    ("xz", "archive", "fd377a585a00", "595a", 4096),
    ("jp2", "image", "0000000c6a5020200d0a870a", "", 100),
    ("exr", "image", "762f3101", "", 500),
    ("pcap", "database", "d4c3b2a1 a1b2c3d4 4d3cb2a1 a1b23c4d", "", 10240),
    ("pcapng", "database", "0a0d0d0a", "", 10240),
    ("evtx", "database", "456c6646696c6500", "", 1024),
    ("vcf", "document", "424547494e3a56434152440d0a 424547494e3a56434152440a", "454e443a56434152440d0a 454e443a56434152440a", 10),
    ("ics", "document", "424547494e3a5643414c454e4441520d0a 424547494e3a5643414c454e4441520a", "454e443a5643414c454e4441520d0a 454e443a5643414c454e4441520a", 50),
    ("m2ts", "video", "4742470000 4742470180", "", 10240),
    ("vhd", "archive", "636f6e6563746978", "", 10240),
    ("vmdk", "archive", "4b444d56", "", 102400),
    ("qcow2", "archive", "514649fb", "", 102400),
    ("bson", "database", "", "", 0),
    ("wal", "database", "377f0682 377f0683", "", 500),
)
#: Too frequent to be of use in a deep scan.
DISABLED = ("ico", "exe", "elf")


def headers(disabled: tuple[str, ...] = DISABLED) -> list[tuple[bytes, str]]:
    """(pattern, extension) of all enabled signatures; a signature without a header has none."""
    return [(bytes.fromhex(h), ext) for ext, _, hs, _, _ in SIGNATURES if ext not in disabled for h in hs.split()]


def footers() -> dict[str, list[bytes]]:
    return {ext: [bytes.fromhex(f) for f in fs.split()] for ext, _, _, fs, _ in SIGNATURES if fs}


def largest() -> dict[str, int]:
    return {ext: mb * MB for ext, _, _, _, mb in SIGNATURES}


def categories() -> dict[str, str]:
    return {ext: category for ext, category, _, _, _ in SIGNATURES}


def table(spark: SparkSession) -> DataFrame:
    """extension, category, headers, footers, max_size."""
    rows = [(e, c, [bytearray.fromhex(x) for x in hs.split()], [bytearray.fromhex(x) for x in fs.split()], mb * MB) for e, c, hs, fs, mb in SIGNATURES]
    return spark.createDataFrame(rows, "extension string, category string, headers array<binary>, footers array<binary>, max_size long")


def overlap(patterns: list[bytes]) -> int:
    """Bytes that a block must reach into the next, so that no pattern is cut."""
    return max(64, max(map(len, patterns), default=1) - 1)
