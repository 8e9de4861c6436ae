"""Tables of the older combustion plant database."""

# Columns and types of every table, as published.
PLANT_TABLES = {
    "1_BasicData": """
        ID int, MemberState string, ReferenceYear int, NumberOfPlants int, Organization string,
        Address1 string, Address2 string, City string, State string, PostalCode string,
        NameOfContactPerson string, Phone string, EMail string
    """,
    "2_Plant": """
        ID int, FK_BasicData_ID int, Unique_Plant_ID string, Reported_Plant_ID string,
        PlantName string, FacilityName string, EPRTRNationalId string, Address1 string,
        Address2 string, City string, Region string, PostalCode string, Longitude double,
        Latitude double, Updated boolean, UpdateComment string, GasEngine boolean,
        GasEngineThermalInput double, DieselEngine boolean, DieselEngineThermalInput double,
        Other boolean, OtherTypeOfCombustion string, OtherThermalInput double,
        OperatingHours double, Comments string
    """,
    "3_PlantDetails": """
        ID int, FK_Plant_ID int, Unique_Plant_ID string, PlantName string,
        StatusOfThePlant string, MWth double, ExtensionBy50MWOrMore boolean,
        CapacityAddedMW double, SubstantialChange boolean, CapacityAffectedMW double,
        DateOfStartOfOperation string, Refineries boolean, OtherSector string, GasEngine boolean,
        GasEngineThermalInput double, DieselEngine boolean, DieselEngineThermalInput double,
        Other boolean, OtherTypeOfCombustion string, OtherThermalInput double,
        OperatingHours double, Comments string
    """,
    "4_EnergyInputAndTotalEmissionsToAir": """
        ID int, FK_Plant_ID int, Unique_Plant_ID string, PlantName string, Biomass double,
        OtherSolidFuels double, LiquidFuels double, NaturalGas double, OtherGases double,
        SO2 double, NOx double, Dust double
    """,
    "5_OptOutsAndNERP": """
        ID int, FK_Plant_ID int, Unique_Plant_ID string, PlantName string, OptOutPlant boolean,
        CapacityOptedOutMW double, HoursOperated double, PlantIncludedInNERP boolean
    """,
    "6_LcpArt15": """
        ID int, FK_Plant_ID int, Unique_Plant_ID string, PlantName string, Art5_1 boolean,
        OperatingHours double, ElvSO2 double, NotaBeneAnnexIII boolean, NotaBeneElvSO2 boolean,
        DesulphurisationRate double, SInput double, AnnexVI_A_Footnote2 boolean,
        AnnexVI_A_Footnote2_OperatingHours double, ElvNOx double, AnnexVI_A_Footnote3 boolean,
        VolatileContents double, AnnexVI_A_Footnote3_ElvNOx double, Comments string
    """,
}
