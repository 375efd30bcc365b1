"""What a call's name, category and arguments say: layers, filters and sizes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories of calls.
POSIX, MPIIO, MPI, HDF5, USER = 0, 1, 2, 3, 4
USER_FUNCTION_ID = 255
#: Which argument of a function is an offset in its file.
OFFSET_ARGUMENTS = {
    **dict.fromkeys(("lseek", "lseek64", "fseek", "fseeko", "MPI_File_seek", "MPI_File_seek_shared"), 1),
    **{f"MPI_File_{f}": 1 for f in ("read_at", "read_at_all", "read_at_all_begin", "iread_at", "write_at", "write_at_all", "write_at_all_begin", "iwrite_at")},
    **dict.fromkeys(("pread", "pread64", "pwrite", "pwrite64"), 3),
    **dict.fromkeys(("mmap", "mmap64"), 5),
}


def any_of(name: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(p) for p in parts])


def category_of(func_id: Column, name: Column, first_mpi: int, first_hdf5: int) -> Column:
    """Category from the id's place among the layers' first ids; MPI_File functions are MPI-IO."""
    return (
        F.when(func_id == USER_FUNCTION_ID, USER)
        .when(func_id < first_mpi, POSIX)
        .when(func_id < first_hdf5, F.when(name.startswith("MPI_File"), MPIIO).otherwise(MPI))
        .otherwise(HDF5)
    )


def function_name(func_id: Column, listed: Column, args: Column) -> Column:
    """The listed name; for a user function its symbol, the second argument."""
    return F.when(func_id == USER_FUNCTION_ID, F.get(args, F.lit(1))).otherwise(listed)


def layer(name: Column) -> Column:
    return F.when(name.contains("H5"), "hdf5").when(name.contains("MPI"), "mpi").otherwise("posix")


def is_data_name(name: Column) -> Column:
    """Data operations: names with read or write."""
    return any_of(name, ["read", "write"])


def is_metadata_name(name: Column) -> Column:
    """Metadata operations: no MPI or HDF5; directories and links always, others unless they move data or a cursor."""
    plain = ~any_of(name, ["MPI", "H5"])
    return plain & (any_of(name, ["dir", "link"]) | ~any_of(name, ["read", "write", "seek", "tell", "open", "close", "sync"]))


def is_report_metadata_name(name: Column) -> Column:
    """The report's narrower list: no layer above POSIX, and nothing that tells, writes, reads, opens, closes or seeks."""
    return ~any_of(name, ["MPI", "H5", "tell", "write", "read", "open", "close", "seek"])


def feeds_intervals(name: Column, category: Column) -> Column:
    """Calls that the offset reconstruction reads: POSIX without directories and links, and MPI-IO data calls."""
    data = any_of(name, ["MPI_File_write", "MPI_File_read", "MPI_File_iread", "MPI_File_iwrite"])
    return ~any_of(name, ["dir", "link"]) & ((category == POSIX) | ((category == MPIIO) & data))


def on_timeline(level: Column, category: Column) -> Column:
    return (level == 0) | category.isin(POSIX, MPIIO, HDF5)


def number(args: Column, i: int) -> Column:
    """Argument i as a whole number, null where it is none."""
    return F.get(args, F.lit(i)).try_cast("bigint")


def offset_of(name: Column, args: Column) -> Column:
    """The offset argument of a call, null for functions without one."""
    places = sorted(set(OFFSET_ARGUMENTS.values()))
    return F.coalesce(*[F.when(name.isin(*[f for f, i in OFFSET_ARGUMENTS.items() if i == place]), number(args, place)) for place in places])


def io_size(name: Column, args: Column) -> Column:
    """Bytes that a POSIX data call asked for; null for others and for sizes of zero or below."""
    size = (
        F.when(name.isin("fread", "fwrite"), number(args, 1) * number(args, 2))
        .when(name.isin("readv", "writev"), number(args, 1))
        .when(name.isin("fprintf", "vfprintf"), number(args, 1))
        .when(is_data_name(name), number(args, 2))
    )
    known = ~any_of(name, ["dir", "MPI", "H5"]) & (is_data_name(name) | name.isin("fprintf", "vfprintf"))
    return F.when(known & (size > 0), size)


def path_accepted(path: Column, exclude: Sequence[str] = (), include: Sequence[str] = ()) -> Column:
    """False for null and for excluded prefixes; with an inclusion list, only its prefixes are true."""
    out = F.lit(False)
    starts = lambda prefixes: reduce(lambda a, b: a | b, [path.startswith(p) for p in prefixes], F.lit(False))
    wanted = starts(include) if include else F.lit(True)
    return F.when(path.isNull(), out).when(starts(exclude), out).otherwise(wanted)


#: POSIX calls that are recorded whatever their files; dup and dup2 go by a descriptor whose file isn't recorded.
NEVER_FILTERED = (
    "linkat", "symlink", "rename", "readdir", "closedir", "rewinddir", "getcwd", "mknod", "mknodat", "pipe", "umask", "tmpfile", "msync", "dup", "dup2",
)
#: POSIX calls whose file isn't their first argument, and its place.
FILE_ARGUMENTS = {
    **dict.fromkeys(("fread", "fwrite"), 3),
    **dict.fromkeys(("mmap", "mmap64"), 4),
    **dict.fromkeys(("__xstat", "__xstat64", "__lxstat", "__lxstat64", "__fxstat", "__fxstat64", "symlinkat"), 1),
}


def path_position(name: Column) -> Column:
    """Which argument of a POSIX call holds the file it is recorded for; null for calls that are recorded for none."""
    out = F.when(name.isin(*NEVER_FILTERED), F.lit(None).cast("int"))
    for place in sorted(set(FILE_ARGUMENTS.values())):
        out = out.when(name.isin(*[f for f, i in FILE_ARGUMENTS.items() if i == place]), place)
    return out.otherwise(0)


def path_of(name: Column, args: Column) -> Column:
    return F.get(args, path_position(name))


def filter_paths(calls: DataFrame, exclude: Sequence[str] = (), include: Sequence[str] = ()) -> DataFrame:
    """Calls on accepted files. POSIX calls go by their file, and stay if they are recorded for none; MPI-IO calls go by the
    handle of an accepted MPI_File_open of their rank, while opens and closes stay; other layers stay."""
    posix = F.col("category") == POSIX
    handle = F.get("args", F.lit(0))
    always = F.col("func").isin("MPI_File_open", "MPI_File_close")
    opened = calls.filter((F.col("func") == "MPI_File_open") & path_accepted(F.get("args", F.lit(1)), exclude, include))
    opened = opened.select(F.col("rank").alias("_r"), F.get("args", F.lit(4)).alias("_h")).filter("_h is not null").distinct()
    free = F.col("func").isin(*NEVER_FILTERED)
    kept = calls.filter(F.when(posix, free | path_accepted(path_of(F.col("func"), F.col("args")), exclude, include)).otherwise((F.col("category") != MPIIO) | always))
    by_handle = calls.filter((F.col("category") == MPIIO) & ~always).join(opened, (F.col("rank") == F.col("_r")) & (handle == F.col("_h")), "left_semi")
    return kept.unionByName(by_handle)


def filter_layers(calls: DataFrame, posix: bool = True, mpi: bool = True, mpiio: bool = True, hdf5: bool = True, user: bool = True, fcntl: bool = True) -> DataFrame:
    """Switch layers off, and fcntl by itself."""
    on = [c for c, want in ((POSIX, posix), (MPI, mpi), (MPIIO, mpiio), (HDF5, hdf5), (USER, user)) if want]
    keep = F.col("category").isin(on) if on else F.lit(False)
    return calls.filter(keep if fcntl else keep & (F.col("func") != "fcntl"))


def blank_out(calls: DataFrame, log_tid: bool = False, log_level: bool = True, log_pointer: bool = False) -> DataFrame:
    """What a trace without thread ids, levels or pointers would hold."""
    out = calls
    if not log_tid:
        out = out.withColumn("tid", F.lit(0).cast("bigint"))
    if not log_level:
        out = out.withColumn("level", F.lit(0))
    if not log_pointer:
        out = out.withColumn("args", F.transform("args", lambda a: F.when(a.rlike("^0x[0-9a-fA-F]+$"), "%p").otherwise(a)))
    return out


def user_function_args(library: Column, symbol: Column) -> Column:
    return F.array(library, symbol)


def int_list(text: Column) -> Column:
    """``[a,b,c]`` as an array of strings; empty for ``[]`` and for what isn't such a list."""
    inner = F.regexp_extract(text, r"^\[(.*)\]$", 1)
    return F.when(F.length(inner) > 0, F.split(inner, ",")).otherwise(F.array().cast("array<string>"))


def status_pair(text: Column) -> Column:
    """``[source_tag]`` as a struct of source and tag; null for an ignored status."""
    hit = text.rlike(r"^\[-?\d+_-?\d+\]$")
    return F.when(hit, F.struct(F.regexp_extract(text, r"^\[(-?\d+)_", 1).cast("int").alias("src"), F.regexp_extract(text, r"_(-?\d+)\]$", 1).cast("int").alias("tag")))


#: Names behind the numbers of HDF5 selection operators, property list classes and datatype classes.
H5_SELECTION = (
    "H5S_SELECT_SET", "H5S_SELECT_OR", "H5S_SELECT_AND", "H5S_SELECT_XOR", "H5S_SELECT_NOTB", "H5S_SELECT_NOTA", "H5S_SELECT_APPEND", "H5S_SELECT_PREPEND",
)
H5_PROPERTY_CLASSES = (
    "H5P_ROOT", "H5P_OBJECT_CREATE", "H5P_FILE_CREATE", "H5P_FILE_ACCESS", "H5P_DATASET_CREATE", "H5P_DATASET_ACCESS", "H5P_DATASET_XFER", "H5P_FILE_MOUNT", "H5P_GROUP_CREATE", "H5P_GROUP_ACCESS",
    "H5P_DATATYPE_CREATE", "H5P_DATATYPE_ACCESS", "H5P_STRING_CREATE", "H5P_ATTRIBUTE_CREATE", "H5P_OBJECT_COPY", "H5P_LINK_CREATE", "H5P_LINK_ACCESS",
)
H5_TYPE_CLASSES = (
    "H5T_INTEGER", "H5T_FLOAT", "H5T_TIME", "H5T_STRING", "H5T_BITFIELD", "H5T_OPAQUE", "H5T_COMPOUND", "H5T_REFERENCE", "H5T_ENUM", "H5T_VLEN", "H5T_ARRAY",
)
#: Native datatypes by class, size in bytes and sign; sizes are those of 64-bit Unix, where long long is another name of long.
H5_NATIVE = {
    (0, 1, True): "H5T_NATIVE_SCHAR", (0, 1, False): "H5T_NATIVE_UCHAR", (0, 2, True): "H5T_NATIVE_SHORT", (0, 2, False): "H5T_NATIVE_USHORT",
    (0, 4, True): "H5T_NATIVE_INT", (0, 4, False): "H5T_NATIVE_UINT", (0, 8, True): "H5T_NATIVE_LONG", (0, 8, False): "H5T_NATIVE_ULONG",
    (1, 4, True): "H5T_NATIVE_FLOAT", (1, 8, True): "H5T_NATIVE_DOUBLE", (1, 16, True): "H5T_NATIVE_LDOUBLE",
}


def decoded(code: Column, names: Sequence[str]) -> Column:
    """The name at a number's place, else the number itself."""
    return F.coalesce(F.get(F.array(*map(F.lit, names)), code.try_cast("int")), code)


def h5_type_name(type_class: Column, size: Column, order: Column, signed: Column) -> Column:
    """A datatype's name from its class, bytes, order (``BE``, ``LE``, ``VAX`` or ``native``) and sign.

    Standard integers and IEEE or VAX floats are named by their bits, native ones as in C, other classes by the class.
    What has no name is given by its class number, as text.
    """
    bits = (size * 8).cast("string")
    native = F.coalesce(*[F.when((type_class == c) & (size == n) & (signed == F.lit(s) if c == 0 else F.lit(True)), name) for (c, n, s), name in H5_NATIVE.items()])
    integer = F.when(order.isin("BE", "LE") & size.isin(1, 2, 4, 8), F.concat(F.lit("H5T_STD_"), F.when(signed, "I").otherwise("U"), bits, order))
    real = F.when(size.isin(4, 8), F.when(order == "VAX", F.concat(F.lit("H5T_VAX_F"), bits)).when(order.isin("BE", "LE"), F.concat(F.lit("H5T_IEEE_F"), bits, order)))
    named = F.when(order == "native", native).when(type_class == 0, integer).when(type_class == 1, real)
    return F.coalesce(F.when(type_class.isin(0, 1), named).otherwise(F.get(F.array(*map(F.lit, H5_TYPE_CLASSES)), type_class)), type_class.cast("string"))


def h5_names(calls: DataFrame) -> DataFrame:
    """rank, seq_id, func and ``name``: the class of created datatypes and property lists, the operator of selections."""
    first, second = F.get("args", F.lit(0)), F.get("args", F.lit(1))
    f = F.col("func")
    name = F.when(f == "H5Tcreate", decoded(first, H5_TYPE_CLASSES)).when(f == "H5Pcreate", decoded(first, H5_PROPERTY_CLASSES)).otherwise(decoded(second, H5_SELECTION))
    return calls.filter(f.isin("H5Tcreate", "H5Pcreate", "H5Sselect_elements", "H5Sselect_hyperslab")).select("rank", "seq_id", "func", name.alias("name"))


def kernel_calls(kernels: DataFrame, resolution_ns: int = 100) -> DataFrame:
    """Rows of GPU kernels (rank, tid, seq_id, name, start_ns and end_ns since the trace's origin) as calls of a user function.

    Its arguments are a reserved word and the kernel's name, which is its symbol. A kernel without an end has none; null
    names stay null.
    """
    tick = lambda c: F.floor(F.col(c) / resolution_ns).cast("bigint")
    return kernels.select(
        "rank", "seq_id", "tid", F.lit(USER_FUNCTION_ID).cast("smallint").alias("func_id"), F.lit(USER).alias("category"), F.lit(0).alias("level"), tick("start_ns").alias("tick_start"), tick("end_ns").alias("tick_end"),
        (F.col("start_ns") / 1e9).alias("tstart"), (F.col("end_ns") / 1e9).alias("tend"), F.lit(2).alias("arg_count"), user_function_args(F.lit("reserved"), F.col("name")).alias("args"),
    )
