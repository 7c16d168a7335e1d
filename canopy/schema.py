"""The engine's tables: what each operator takes and returns."""

from __future__ import annotations

IMAGE = (
    "image_id string, layer_no int, blksz int, blkszbits int, root_nid long, packed_nid long, metabox_nid long, inos long, epoch long, "
    "build_time long, fixed_nsec int, primary_blocks long, total_blocks long, meta_blkaddr long, xattr_blkaddr long, uuid string, "
    "volume_name string, feature_compat long, feature_incompat long, features array<string>, compr_algs array<string>, checksum long, "
    "checksum_ok boolean, sb_size int, extra_devices int, devt_slotoff int"
)
DEVICE = "image_id string, device_id int, tag string, blocks long, uniaddr long"
INODE = (
    "image_id string, nid long, ino long, mode int, ftype int, uid long, gid long, nlink long, size long, mtime_s long, mtime_ns int, "
    "datalayout int, inode_isize int, xattr_isize int, rdev long, startblk long, chunkbits int, iloc long"
)
DIRENT = "image_id string, dir_nid long, lblk long, idx int, name binary, nid long, ftype int"
XATTR = "image_id string, nid long, prefix_index int, name string, value binary, shared_id long"
EXTENT = "image_id string, nid long, ext_no int, la long, llen long, pa long, plen long, device_id int, mapped boolean"
ENTRY = (
    "source_id string, layer_no int, seq long, path string, linkpath string, typeflag string, mode int, uid long, gid long, size long, "
    "mtime_s long, mtime_ns int, rdev long, data_off long, xattrs map<string,binary>"
)

#: File types by number, and the mode bits that say so.
FILE_TYPES = {0: "unknown type", 1: "regular file", 2: "directory", 3: "char dev", 4: "block dev", 5: "FIFO file", 6: "SOCK file", 7: "symlink file"}
MODE_TYPES = {0x8000: 1, 0x4000: 2, 0x2000: 3, 0x6000: 4, 0x1000: 5, 0xC000: 6, 0xA000: 7}
#: Extensions that the report on extensions knows, in order.
KNOWN_EXTENSIONS = (".txt", ".so", ".xml", ".apk", ".odex", ".vdex", ".oat", ".rc", ".otf")
#: Fixed values: (compatible, least kernel as major * 100 + minor, bit, name).
FEATURES = (
    (True, 0, 0x001, "sb_csum"),
    (True, 0, 0x002, "mtime"),
    (True, 0, 0x004, "xattr_filter"),
    (True, 0, 0x008, "shared_ea_in_metabox"),
    (True, 0, 0x010, "plain_xattr_pfx"),
    (True, 0, 0x020, "ishare_xattrs"),
    (False, 504, 0x001, "lz4_0padding"),
    (False, 513, 0x002, "compr_cfgs"),
    (False, 513, 0x002, "big_pcluster"),
    (False, 515, 0x004, "chunked_file"),
    (False, 516, 0x008, "device_table"),
    (False, 517, 0x010, "ztailpacking"),
    (False, 601, 0x020, "fragments"),
    (False, 601, 0x020, "dedupe"),
    (False, 604, 0x040, "xattr_prefixes"),
    (False, 615, 0x080, "48bit"),
    (False, 617, 0x100, "metabox"),
)
#: Bit in the set of available algorithms, name, least kernel.
ALGORITHMS = ((0, "lz4", 0), (1, "lzma", 516), (2, "deflate", 606), (3, "zstd", 610))
