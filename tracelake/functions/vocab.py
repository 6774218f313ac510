"""Fixed values of trace analytics: function sets, file patterns, size bins, labels."""

# Function names by I/O category, tested in the order METADATA, READ, WRITE, SYNC, PCTL, IPC.
READ = ["fread", "pread", "preadv", "read", "readv"]
WRITE = ["fwrite", "pwrite", "pwritev", "write", "writev"]
SYNC = ["fdatasync", "fsync", "msync", "sync"]
PCTL = ["exec", "exit", "fork", "kill", "pipe", "wait"]
IPC = ["msgctl", "msgget", "msgrcv", "msgsnd", "semctl", "semget", "semop", "shmat", "shmctl", "shmdt", "shmget"]
METADATA = [
    "__fxstat", "__fxstat64", "__lxstat", "__lxstat64", "__xstat", "__xstat64", "access", "close", "closedir", "fclose", "fcntl", "fopen", "fopen64", "fseek", "fstat", "fstatat",
    "ftell", "ftruncate", "link", "lseek", "lseek64", "mkdir", "open", "open64", "opendir", "readdir", "readlink", "remove", "rename", "rmdir", "seek", "stat", "unlink",
]
IO_CODES = {"METADATA": 3, "READ": 1, "WRITE": 2, "SYNC": 7, "PCTL": 4, "IPC": 5, "OTHER": 6}

# Record labels of functions; METADATA comes first and is labelled `metadata`.
LABELS = {
    "read": ["pread", "pread64", "preadv", "read", "readv"],
    "write": ["pwrite", "pwrite64", "pwritev", "write", "writev"],
    "open": ["openat"],
    "stat": ["lstat"],
}

# Functions that aren't analysed, by name or by a part of it.
IGNORED_FUNCTIONS = [
    "DLIOBenchmark.__init__", "DLIOBenchmark.initialize", "FileStorage.__init__", "IndexedBinaryMMapReader.__init__", "IndexedBinaryMMapReader.load_index", "IndexedBinaryMMapReader.next",
    "IndexedBinaryMMapReader.read_index", "NPZReader.__init__", "NPZReader.next", "NPZReader.read_index", "PyTorchCheckpointing.__init__", "PyTorchCheckpointing.finalize",
    "PyTorchCheckpointing.get_tensor", "SCRPyTorchCheckpointing.__init__", "SCRPyTorchCheckpointing.finalize", "SCRPyTorchCheckpointing.get_tensor", "TFCheckpointing.__init__",
    "TFCheckpointing.finalize", "TFCheckpointing.get_tensor", "TFDataLoader.__init__", "TFDataLoader.finalize", "TFDataLoader.next", "TFDataLoader.read", "TFFramework.get_loader",
    "TFFramework.init_loader", "TFFramework.is_nativeio_available", "TFFramework.trace_object", "TFReader.__init__", "TFReader.next", "TFReader.read_index", "TorchDataLoader.__init__",
    "TorchDataLoader.finalize", "TorchDataLoader.next", "TorchDataLoader.read", "TorchDataset.__init__", "TorchFramework.get_loader", "TorchFramework.init_loader",
    "TorchFramework.is_nativeio_available", "TorchFramework.trace_object",
]
IGNORED_PARTS = [".save_state", "checkpoint_end_", "checkpoint_start_"]

# Parts of file names whose events aren't analysed.
IGNORED_PATHS = ["/dev/", "/etc/", "/gapps/python", "/lib/python", "/proc/", "/software/", "/sys/", "/usr/lib", "/usr/tce/backend", "/usr/tce/packages", "/venv", "__pycache__"]

# Suffix of a posix or stdio category by a part of the file name; the first that holds.
PATH_SUFFIXES = [("/checkpoint", "_checkpoint"), ("/data", "_reader"), ("/lustre", "_lustre"), ("/ssd", "_ssd")]

# Size bins, each from its bound (inclusive) to the next (exclusive).
BIN_BOUNDS = [0, *[4**k << 10 for k in range(1, 12)]]
BIN_SUFFIXES = [
    "0_4kib", "4kib_16kib", "16kib_64kib", "64kib_256kib", "256kib_1mib", "1mib_4mib", "4mib_16mib", "16mib_64mib", "64mib_256mib", "256mib_1gib", "1gib_4gib", "4gib_plus",
]
BIN_LABELS = [
    "<4 KiB", "4 KiB - 16 KiB", "16 KiB - 64 KiB", "64 KiB - 256 KiB", "256 KiB - 1 MiB", "1 MiB - 4 MiB", "4 MiB - 16 MiB", "16 MiB - 64 MiB", "64 MiB - 256 MiB", "256 MiB - 1 GiB",
    "1 GiB - 4 GiB", ">4 GiB",
]
BIN_NAMES = ["<4 kiB", "4 KiB", "16 KiB", "64 KiB", "256 KiB", "1 MiB", "4 MiB", "16 MiB", "64 MiB", "256 MiB", "1 GiB", ">4 GiB"]
BIN_COLUMNS = [f"size_bin_{s}" for s in BIN_SUFFIXES]

# Names for readers.
COLUMN_LABELS = {
    "acc_pat": "Access Pattern", "app_io_time": "Application I/O Time", "app_name": "Application", "behavior": "Behavior", "cat": "Category", "checkpoint_io_time": "Checkpoint I/O Time",
    "compute_time": "Compute Time", "count": "Count", "file_dir": "File Directory", "file_name": "File", "file_pattern": "File Pattern", "func_name": "Function Name", "host_name": "Host",
    "io_cat": "I/O Category", "io_time": "I/O Time", "node_name": "Node", "proc_name": "Process", "rank": "Rank", "read_io_time": "Read I/O Time", "size": "Size", "time": "Time",
    "time_range": "Time Period", "u_app_compute_time": "Unoverlapped Application Compute Time", "u_app_io_time": "Unoverlapped Application I/O Time",
    "u_checkpoint_io_time": "Unoverlapped Checkpoint I/O Time", "u_compute_time": "Unoverlapped Compute Time", "u_io_time": "Unoverlapped I/O Time", "u_read_io_time": "Unoverlapped Read I/O Time",
}
METRIC_LABELS = {"bw": "I/O Bandwidth", "intensity": "I/O Intensity", "iops": "I/O Operations per Second", "time": "I/O Time"}
VIEW_LABELS = {
    "app_name": "App", "file_dir": "File Directory", "file_name": "File", "file_pattern": "File Pattern", "node_name": "Node", "proc_name": "Process", "rank": "Rank", "time_range": "Time Period",
}
VIEWS = ["file_name", "proc_name", "time_range"]
LOGICAL_VIEWS = {"file_name": ["file_dir", "file_pattern"], "proc_name": ["app_name", "host_name", "node_name", "proc_id", "rank", "thread_id"]}
IO_TYPES, COMPACT_IO_TYPES = ["read", "write", "metadata"], ["R", "W", "M"]
DERIVED_METADATA_OPERATIONS, ACCESS_PATTERNS = ["close", "open", "seek", "stat"], {"SEQUENTIAL": 0, "RANDOM": 1}
EXTRA_KEYS = ["cat", "io_cat", "acc_pat", "func_name"]
EPOCH_CATEGORY, EPOCH_NAMES = "pipeline", ["epoch", "epoch.block"]
TYPE_CODES = {"FH": 1, "HH": 2, "SH": 3, "PR": 4}
REGULAR, OTHER_METADATA = 0, 5
REPLAY_FUNCTIONS = ["open", "open64", "openat", "close", "read", "pread", "pread64", "write", "pwrite", "pwrite64", "lseek", "lseek64", "stat", "stat64", "lstat", "fstat"]
