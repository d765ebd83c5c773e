"""Order-driven operators on streams; on closed input they equal their batch forms."""
