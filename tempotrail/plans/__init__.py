"""The queries: operators on the race model that proxy.py derives from the driver tables, and their SQL."""
