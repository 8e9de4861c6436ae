"""Tables of the industrial reporting database."""

# Columns and types of every table, as published.
REPORTING_TABLES = {
    "0a_DataCollectionMetadata_EUReg": """
        fileId int, envelopeUrl string, filename string, dateSubmitted timestamp_ntz,
        dateReleased timestamp_ntz, dateImported timestamp_ntz, fileSHA256Hash string,
        countryCode string, reportingYear int, obligation int
    """,
    "1_ProductionSite": """
        fileId_EUReg int, Site_INSPIRE_ID string, ProductionSite_thematicId string,
        ProductionSite_thematicIdScheme string, pointGeometryLat double, pointGeometryLon double,
        nameOfFeature string, countryCode string
    """,
    "2_ProductionFacility": """
        fileId_EUReg int, Parent_Site_INSPIRE_ID string, Facility_INSPIRE_ID string,
        ProductionFacility_thematicId string, ProductionFacility_thematicIdScheme string,
        parentCompanyName string, parentCompanyURL string,
        parentCompany_confidentialityReasonCode string,
        parentCompany_confidentialityReasonName string, nameOfFeature string,
        facilityName_confidentialityReasonCode string,
        facilityName_confidentialityReasonName string, facilityType string,
        pointGeometryLat double, pointGeometryLon double, streetName string,
        buildingNumber string, city string, postalCode string, countryCode string,
        addressDetails_confidentialityReasonCode string,
        addressDetails_confidentialityReasonName string, mainActivityCode string,
        mainActivityName string, RBDSourceCode string, RBDSourceName string,
        NUTSRegionSourceCode string, NUTSRegionSourceName string,
        dateOfStartOfOperation timestamp_ntz
    """,
    "2a_ProductionFacilityDetails": """
        fileId_EUReg int, fileId_EPRTR_LCP int, ProductionFacilityDetailsID int,
        Facility_INSPIRE_ID string, reportingYear int, status string, remarks string,
        numberOfOperatingHours int, numberOfEmployees int, stackHeightClass string,
        representativeStackHeightM int, confidentialityReasonCode string,
        confidentialityReasonName string
    """,
    "2c_Function": """
        FunctionId int, Facility_INSPIRE_ID string, NACEMainEconomicActivityCode string,
        NACEMainEconomicActivityName string
    """,
    "2f_PollutantRelease": """
        fileId_EPRTR_LCP int, PollutantReleaseId int, Facility_INSPIRE_ID string,
        reportingYear int, pollutantCode string, pollutantName string, medium string,
        totalPollutantQuantityKg double, accidentalPollutantQuantityKG double, methodCode string,
        methodName string, furtherDetails string, confidentialityReasonCode string,
        confidentialityReasonName string
    """,
    "3b_IEDAnnexIOtherActivity": """
        IEDAnnexIActivityId int, Installation_INSPIRE_ID string, reportingYear int,
        otherActivityCode string, otherActivityName string
    """,
    "3d_BATConclusions": """
        BATConclusionId int, Installation_INSPIRE_ID string, reportingYear int,
        BATConclusionCode string, BATConclusionName string
    """,
    "3e_BATDerogations": """
        BATDerogationId int, Installation_INSPIRE_ID string, reportingYear int,
        BATDerogationIndicator int, publicReasonURL string, BATAELCode string, BATAELName string,
        derogationDurationStartDate timestamp_ntz, derogationDurationEndDate timestamp_ntz
    """,
    "3a_ProductionInstallationDetails": """
        fileId_EUReg int, ProductionInstallationDetailsID int, Installation_INSPIRE_ID string,
        reportingYear int, status string, baselineReportIndicator string,
        publicEmissionMonitoring string, publicEmissionMonitoringURL string, remarks string,
        siteVisitNumber int, siteVisitURL string
    """,
    "3_ProductionInstallation": """
        fileId_EUReg int, Parent_Facility_INSPIRE_ID string, Installation_INSPIRE_ID string,
        ProductionInstallation_thematicId string, ProductionInstallation_thematicIdScheme string,
        nameOfFeature string, installationName_confidentialityReasonCode string,
        installationName_confidentialityReasonName string, installationType string,
        pointGeometryLat double, pointGeometryLon double, mainActivityCode string,
        mainActivityName string, dateOfStartOfOperation timestamp_ntz
    """,
    "3j_OtherRelevantChapters": """
        OtherRelevantChaptersId int, Installation_INSPIRE_ID string,
        otherRelevantChaptersCode string, otherRelevantChaptersName string
    """,
    "3c_PermitDetails": """
        PermitId int, Installation_INSPIRE_ID string, reportingYear int, permitGranted int,
        permitReconsidered int, permitUpdated int, dateOfGranting timestamp_ntz,
        dateOfLastUpdate timestamp_ntz, permitURL string, enforcementAction string
    """,
    "3i_StricterPermitConditions": """
        StricterPermitConditionsID int, Installation_INSPIRE_ID string, reportingYear int,
        stricterPermitConditionsIndicator int, BATAELCode string, BATAELName string,
        `Article14(4)` int, Article18 int
    """,
    "4_ProductionInstallationPart": """
        fileId_EUReg int, fileId_EPRTR_LCP int, Parent_Installation_INSPIRE_ID string,
        Installation_Part_INSPIRE_ID string, ProductionInstallationPart_thematicId string,
        ProductionInstallationPart_thematicIdScheme string, nameOfFeature string,
        installationPartName_confidentialityReasonCode string,
        installationPartName_confidentialityReasonName string, plantType string,
        pointGeometryLat double, pointGeometryLon double, dateOfStartOfOperation timestamp_ntz,
        publicDisclosure string, combustionPlantCategory string, totalRatedThermalInput double,
        withinRefinery int, untreatedMunicipalWaste int, heatReleaseHazardousWaste int,
        totalNominalCapacityAnyWasteType double, permittedCapacityHazardous double,
        permittedCapacityNonHazardous double, confidentialityReasonCode string,
        confidentialityReasonName string, publicDisclosureURL string
    """,
    "4a_ProductionInstallationPartDetails": """
        fileId_EUReg int, fileId_EPRTR_LCP int, ProductionInstallationPartID int,
        Installation_Part_INSPIRE_ID string, reportingYear int, status string,
        numberOfOperatingHours int, remarks string,
        proportionofUsefulHeatProductionForDistrictHeating double, specificConditions string,
        conditionsInformation string, specificConditionsPermitURL string,
        confidentialityReasonCode string, confidentialityReasonName string
    """,
    "4b_DesulphurisationInformation": """
        fileId_EPRTR_LCP int, DesulphurisationInformationId int,
        Installation_Part_INSPIRE_ID string, reportingYear int, month string,
        desulphurisationRate double, sulphurContent double, technicalJustification string
    """,
    "4c_Derogations": """
        fileId int, DerogationsId int, Installation_Part_INSPIRE_ID string, reportingYear int,
        derogationCode string, derogationName string
    """,
    "4d_EnergyInput": """
        fileId_EPRTR_LCP int, EnergyInputId int, Installation_Part_INSPIRE_ID string,
        reportingYear int, fuelInputCode string, fuelInputName string, otherSolidFuelCode string,
        otherSolidFuelName string, otherGaseousFuelCode string, otherGaseousFuelName string,
        furtherDetails string, energyInputTJ double, confidentialityReasonCode string,
        confidentialityReasonName string
    """,
    "4e_EmissionsToAir": """
        fileId_EPRTR_LCP int, EmissionsToAirId int, Installation_Part_INSPIRE_ID string,
        reportingYear int, pollutantCode string, pollutantName string,
        totalPollutantQuantityTNE double, confidentialityReasonCode string,
        confidentialityReasonName string
    """,
}
