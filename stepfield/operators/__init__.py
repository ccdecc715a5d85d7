"""DataFrame -> DataFrame operators on trajectory, cell and edge tables."""
