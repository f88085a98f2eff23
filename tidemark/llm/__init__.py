"""Training-data operators: licences, near-duplicates, language, mixing, packing and so on."""

import pyarrow as pa

# Python workers live on between tasks: what a batch took goes back to the system, not to a pool
pa.set_memory_pool(pa.system_memory_pool())
